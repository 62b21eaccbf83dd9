"""Conversation structure repair: the cheapest edits that make roles read ``(s?(ua)+)?``.

Rows of a conversation are put in order, and cut into blocks of bounded size. A block's
costs are a min-plus matrix over four states (nothing yet, after system, after user,
after assistant); the matrices of a conversation, sixteen numbers a block, are folded
from its end, so each block knows what every way out of it costs. Inside a block a cost
DP leaves the optimal arcs. Their nodes are ranked by their least audits of 1, 2, 4, ...
letters, the ranks select one arc a node, and the path is read off through the doubled
pointers of the selected arcs. An edit letter leads from a state to one state only, so
the least path of a block has one way out, and blocks chain by their entry states.

No task holds a conversation: blocks do the work, their summaries are folded, and the
digest of the repaired text is streamed. The audit itself is one string by contract."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.llm.common import written

#: Rows of a block at most.
BLOCK_ROWS = 4096
DELETE, INSERT, KEEP, REROLE = b"DIKR"
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5

_INF = 1 << 40
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. What a user or
#: assistant in its right place leads to:
_NEXT = np.array([2, 2, 3, 2])
#: Initials: 0 system, 1 user, 2 assistant, 3 any other. Where Keep leads to, or -1:
_KEPT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
_NONE, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
_SPACE = r"\x20\x09-\x0D"


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults: by crc32 of ``conv_id:turn`` modulo 20 a row is
    dropped (0), emptied (1), robbed of its ``.!?`` (2), repeated (3), made a user's (4),
    or left. Nulls of role and text become one space, and count as one in the key."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    draw, role, text = F.crc32(key) % 20, F.coalesce("role", space), F.coalesce("text", space)
    found = rows.select(
        "conv_id", "turn",
        F.when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).alias("copies"),
    )
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).where("copies > 0").drop("copies", "copy")


def _minplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), _INF)


def _steps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By state and code (initial + 4 * fault): costs of Delete, Keep and Rerole; the last
    two are infinite where they aren't allowed."""
    delete = np.full((4, 16), DELETE_COST)
    keep, rerole = np.full((4, 16), _INF), np.full((4, 16), _INF)
    for fault in (_NONE, _TRUNCATED):
        more = TRUNCATED_COST if fault == _TRUNCATED else 0
        rerole[:, 4 * fault : 4 * fault + 4] = REROLE_COST + more
        keep[:, 4 * fault : 4 * fault + 4] = np.where(_KEPT >= 0, more, _INF)
    return delete, keep, rerole


_DELETES, _KEEPS, _REROLES = _steps()


def _transfer() -> np.ndarray:
    """Costs from state to state over one row of each code, inserts before it included."""
    inserts = np.full((4, 4), _INF)
    inserts[range(4), range(4)] = 0
    one = inserts.copy()
    one[range(4), _NEXT] = INSERT_COST
    inserts = _minplus(_minplus(one, one), one)
    out = np.full((16, 4, 4), _INF)
    for code in range(16):
        for s in range(4):
            for to, cost in ((s, _DELETES[s, code]), (_KEPT[s, code % 4], _KEEPS[s, code]), (_NEXT[s], _REROLES[s, code])):
                if cost < _INF:
                    out[code, s, to] = min(out[code, s, to], cost)
    return _minplus(inserts[None], out)


_TRANSFER = _transfer()
#: Costs of ending in a state: inserts may follow the last row.
_END = np.array([0, 2 * INSERT_COST, INSERT_COST, 0])


def _matrices(codes: list[np.ndarray]) -> np.ndarray:
    """The min-plus product of each block's rows."""
    order = sorted(range(len(codes)), key=lambda k: -len(codes[k]))
    sizes = np.array([len(codes[k]) for k in order])
    grid = np.zeros((len(codes), sizes[0] if len(sizes) else 0), np.uint8)
    for row, k in enumerate(order):
        grid[row, : len(codes[k])] = codes[k]
    found = _TRANSFER[grid[:, 0]]
    for t in range(1, grid.shape[1]):
        live = int((sizes > t).sum())
        found[:live] = _minplus(found[:live], _TRANSFER[grid[:live, t]])
    out = np.empty_like(found)
    out[order] = found
    return out


def least_paths(codes: list[np.ndarray], exits: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """For each block and each state at its entry, the state at its exit and the least
    audit of the cheapest edits. ``exits`` has the costs of going on from each state after
    the block; blocks that are the last of a conversation may insert behind their rows."""
    n, size = len(codes), max(map(len, codes))
    grid = np.zeros((n, size), np.uint8)
    for k, c in enumerate(codes):
        grid[k, size - len(c) :] = c
    state = np.arange(4)
    cost = np.empty((n, size + 1, 4), np.int64)
    cost[:, size] = np.where(last[:, None], _END, exits)
    for t in range(size - 1, -1, -1):
        code, after = grid[:, t, None], cost[:, t + 1]
        kept = _KEPT[state, code % 4]
        base = np.minimum(
            after + _DELETES[state, code],
            np.minimum(np.take_along_axis(after, np.maximum(kept, 0), 1) + _KEEPS[state, code], after[:, _NEXT] + _REROLES[state, code]),
        )
        once = np.minimum(base, base[:, _NEXT] + INSERT_COST)
        cost[:, t] = np.minimum(once, once[:, _NEXT] + INSERT_COST)

    # Arcs of each node in order of their letters: target, or -1 where not optimal.
    base = (np.arange(n)[:, None, None] * (size + 1) + np.arange(size + 1)[:, None]) * 4
    arcs = np.full((4, n, size + 1, 4), -1)
    code, here, after, down = grid[:, :, None], cost[:, :-1], cost[:, 1:], base[:, 1:]
    kept = np.maximum(_KEPT[state, code % 4], 0)
    arcs[0, :, :-1] = np.where(after + _DELETES[state, code] == here, down + state, -1)
    arcs[2, :, :-1] = np.where(np.take_along_axis(after, kept, 2) + _KEEPS[state, code] == here, down + kept, -1)
    arcs[3, :, :-1] = np.where(after[:, :, _NEXT] + _REROLES[state, code] == here, down + _NEXT, -1)
    inserts = np.where(cost[:, :, _NEXT] + INSERT_COST == cost, base + _NEXT, -1)
    inserts[~last, size] = -1
    arcs[1] = inserts
    arcs = arcs.reshape(4, -1)

    nodes = np.arange(arcs.shape[1])
    ends = (arcs < 0).all(axis=0)
    letter = np.where(ends, 0, 1 + (arcs >= 0).argmax(axis=0))
    # Ranks of least audits by 1, 2, 4, ... letters; a finished one ranks before all that go on.
    rank, jump = letter, np.where(ends, nodes, arcs[np.maximum(letter - 1, 0), nodes])
    while not ends[jump].all():
        rank = np.unique(rank * (arcs.shape[1] + 5) + rank[jump], return_inverse=True)[1]
        jump = jump[jump]
    rank = np.unique(rank * (arcs.shape[1] + 5) + rank[jump], return_inverse=True)[1]
    worth = np.where(arcs >= 0, np.arange(4)[:, None] * len(nodes) + rank[arcs], np.iinfo(np.int64).max)
    chosen = worth.argmin(axis=0)
    jump = np.where(ends, nodes, arcs[chosen, nodes])
    sign = np.where(ends, 0, np.frombuffer(b"DIKR", np.uint8)[chosen]).astype(np.uint8)

    starts = np.array([size - len(c) for c in codes])
    path = (base[np.arange(n), starts] + state).reshape(-1, 1)
    while not ends[path[:, -1]].all():
        path = np.hstack([path, jump[path]])
        jump = jump[jump]
    signs = sign[path]
    audits = [row.tobytes().rstrip(b"\0") for row in signs]
    return (path[:, -1] % 4).reshape(n, 4), [audits[4 * k : 4 * k + 4] for k in range(n)]


def _faulty(rows: DataFrame) -> DataFrame:
    """Rows with ``later`` (same role and text at an earlier turn), blank and truncated."""
    words = rows.select(
        "conv_id", "turn", "role", "text",
        F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
        (~F.col("text").rlike(f"[^{_SPACE}]")).alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")).alias("truncated"),
    )
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = words.groupBy("conv_id", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("first_conv"), F.col("digest").alias("first_digest"), "first")
    same = (F.col("digest") == F.col("first_digest")) & F.col("conv_id").eqNullSafe(F.col("first_conv"))
    found = words.join(firsts, same, "left").withColumn("later", F.coalesce(place > F.col("first"), F.lit(False)))
    return found.drop("first_conv", "first_digest", "first")


def _cut(batches: Iterable[pa.RecordBatch], block_rows: int) -> Iterator[pa.RecordBatch]:
    """Ordered rows with their block, place and fault; the first row of a block has its
    codes, matrix and number of illegal neighbours."""
    bid, before = TaskContext.get().partitionId() << 40, None
    initials = {"s": 0, "u": 1, "a": 2}
    for batch in batches:
        cols = {name: batch.column(name) for name in batch.schema.names}
        convs, turns, digests = cols["conv_id"].to_pylist(), cols["turn"].to_pylist(), cols["digest"].to_pylist()
        faults, marks, starts = [], np.empty(batch.num_rows, np.uint8), []
        flags = zip(cols["blank"].to_pylist(), cols["later"].to_pylist(), cols["truncated"].to_pylist(), strict=True)
        roles = cols["role"].to_pylist()
        for i, (blank, later, truncated) in enumerate(flags):
            here = (convs[i], turns[i], digests[i])
            fault = _BLANK if blank else _DUPLICATE if later or here == before else _TRUNCATED if truncated else _NONE
            before = here
            faults.append(fault)
            marks[i] = initials.get(roles[i][:1], 3) + 4 * fault
            if i == 0 or convs[i] != convs[i - 1] or i - starts[-1] == block_rows:
                starts.append(i)
        if not starts:
            continue
        codes = [marks[a:b] for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True)]
        matrices, at = _matrices(codes), dict(zip(starts, range(len(starts)), strict=True))
        ids, places = [], []
        for k, c in enumerate(codes):
            ids += [bid + k] * len(c)
            places += range(len(c))
        bid += len(codes)
        illegal = {a: _illegal(c % 4) for a, c in zip(starts, codes, strict=True)}
        rows = range(batch.num_rows)
        yield pa.RecordBatch.from_arrays(
            [
                cols["conv_id"], cols["turn"], cols["role"], cols["text"],
                pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(faults, pa.int32()),
                pa.array([codes[at[i]].tobytes() if i in at else None for i in rows], pa.binary()),
                pa.array([matrices[at[i]].ravel().tolist() if i in at else None for i in rows], pa.list_(pa.int64())),
                pa.array([illegal.get(i) for i in rows], pa.int64()),
            ],
            names=["conv_id", "turn", "role", "text", "bid", "place", "fault", "codes", "matrix", "illegal"],
        )


def _illegal(initials: np.ndarray) -> int:
    """Neighbours that aren't system-user, user-assistant or assistant-user."""
    pairs = initials[:-1].astype(int) * 4 + initials[1:]
    return int((~np.isin(pairs, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))).sum())


def _folded_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By conversation: what going on costs after each block, from the last to the first."""
    for batch in batches:
        outs, costs, wrong = [], [], []
        for parts in batch.column("parts").to_pylist():
            found, after = [], _END
            for k in range(len(parts) - 1, -1, -1):
                found.append({"bid": parts[k]["bid"], "exits": [int(x) for x in after], "last": k == len(parts) - 1})
                matrix = np.array(parts[k]["matrix"]).reshape(4, 4)
                after = np.minimum((matrix + after).min(axis=1), _INF)
            outs.append(found)
            costs.append(int(after[0]))
            seams = [_illegal(np.array([a["tail"], b["head"]])) for a, b in zip(parts, parts[1:], strict=False)]
            wrong.append(sum(p["illegal"] for p in parts) + sum(seams))
        kind = pa.list_(pa.struct([("bid", pa.int64()), ("exits", pa.list_(pa.int64())), ("last", pa.bool_())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(costs, pa.int64()), pa.array(wrong, pa.int64()), pa.array(outs, kind)],
            names=["conv_id", "cost", "illegal", "outs"],
        )


def _ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By block: the exit state and the audit for each entry state. Blocks of like sizes
    are ranked together, so that no small block is padded to a large one."""
    for batch in batches:
        codes = [np.frombuffer(c, np.uint8) for c in batch.column("codes").to_pylist()]
        exits, last = np.array(batch.column("exits").to_pylist()), np.array(batch.column("last").to_pylist())
        leaves, audits = [None] * len(codes), [None] * len(codes)
        classes: dict[int, list[int]] = {}
        for k, c in enumerate(codes):
            classes.setdefault(len(c).bit_length(), []).append(k)
        for width, members in classes.items():
            step = max(1, (BLOCK_ROWS << 3) >> width)
            for a in range(0, len(members), step):
                part = members[a : a + step]
                ways, signs = least_paths([codes[k] for k in part], exits[part], last[part])
                for k, way, sign in zip(part, ways, signs, strict=True):
                    leaves[k], audits[k] = way.tolist(), [s.decode() for s in sign]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("bid"), pa.array(leaves, pa.list_(pa.int32())), pa.array(audits, pa.list_(pa.string()))],
            names=["conv_id", "bid", "leaves", "audits"],
        )


def _edits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By row of a block: its letter, the role that Rerole gives, and the roles of what
    is inserted before it, or behind it if it's the block's last."""
    for batch in batches:
        out: list[tuple] = []
        for bid, codes, entry, audit in zip(*(batch.column(c).to_pylist() for c in ("bid", "codes", "entry", "audit")), strict=True):
            state, place, pending = entry, 0, []
            for letter in audit.encode():
                if letter == INSERT:
                    state = int(_NEXT[state])
                    pending.append("user" if state == 2 else "assistant")
                    continue
                role = None
                if letter == KEEP:
                    state = int(_KEPT[state, codes[place] % 4])
                elif letter == REROLE:
                    state = int(_NEXT[state])
                    role = "user" if state == 2 else "assistant"
                out.append((bid, place, chr(letter), role, pending, []))
                place, pending = place + 1, []
            if pending:
                out[-1][5].extend(pending)
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["bid", "place", "edit", "new_role", "before", "behind"]
        )


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ordered lines of each conversation, joined by newlines. Only the
    running digest is held."""
    conv, digest, some = None, None, False

    def done():
        return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    for batch in batches:
        kind = batch.column("conv_id").type
        for c, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
            if digest is None or c != conv:
                if digest is not None:
                    yield done()
                conv, digest, some = c, hashlib.sha256(), False
            if lines is not None:
                digest.update(("\n" + lines if some else lines).encode("utf-8"))
                some = True
    if digest is not None:
        yield done()


class Repair:
    """The repair of conversations (conv_id, turn, role, text; other columns are left
    out). Its tables are written to the shared folder once.

    Rows are taken by turn, nulls first, then by role and text. A null conv_id is a
    conversation of its own; null roles and texts are one space. Repeated rows are
    duplicates of the first. Empty texts are blank. An empty table gives no rows. A
    conversation may be of any length, and texts too: blocks have bounded numbers of
    rows, and texts pass one by one."""

    def __init__(self, rows: DataFrame, block_rows: int = BLOCK_ROWS):
        space = F.lit(" ")
        plain = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
        kind = {f.name: f.dataType.simpleString() for f in plain.schema}
        order = ["conv_id", "turn", "role", "text"]
        ordered = _faulty(plain).repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions(*order)
        given = f"conv_id {kind['conv_id']}, turn {kind['turn']}, role string, text string"
        cut = f"{given}, bid long, place int, fault int, codes binary, matrix array<long>, illegal long"
        self.rows = written(ordered.mapInArrow(lambda batches: _cut(batches, block_rows), cut), "repair-rows")
        conv = f"conv_id {kind['conv_id']}"
        blocks = self.rows.where("place = 0")
        head = F.conv(F.hex(F.substring("codes", 1, 1)), 16, 10).cast("int") % 4
        tail = F.conv(F.hex(F.substring("codes", -1, 1)), 16, 10).cast("int") % 4
        summary = F.struct("bid", "matrix", "illegal", head.alias("head"), tail.alias("tail"))
        gathered = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(summary)).alias("parts"))
        self.costs = written(
            gathered.mapInArrow(_folded_back, f"{conv}, cost long, illegal long, outs array<struct<bid: long, exits: array<long>, last: boolean>>"),
            "repair-costs",
        )
        outs = self.costs.select(F.inline("outs"))
        ways = written(
            blocks.select("conv_id", "bid", "codes").join(outs, "bid").mapInArrow(_ranked, f"{conv}, bid long, leaves array<int>, audits array<string>"),
            "repair-ways",
        )
        chain = ways.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("bid", "leaves"))).alias("parts"))
        entries = chain.select(F.inline(_entries(F.col("parts"))))
        chosen = ways.join(entries, "bid").select("conv_id", "bid", "entry", F.element_at("audits", F.col("entry") + 1).alias("audit"))
        self.chosen = written(chosen, "repair-audits")

    def edits(self) -> DataFrame:
        """bid, place, edit letter, new_role, and the roles inserted before and behind."""
        codes = self.rows.where("place = 0").select("bid", "codes")
        return self.chosen.select("bid", "entry", "audit").join(codes, "bid").mapInArrow(
            _edits, "bid long, place int, edit string, new_role string, before array<string>, behind array<string>"
        )

    def repaired(self) -> DataFrame:
        """One row for each row of the input: conv_id, bid and place (its order), edit,
        and ``turns``, the rows that stand in its place: inserted ones have empty texts."""
        rows = self.rows.select("conv_id", "bid", "place", "turn", "role", "text")

        def empty(roles: Column) -> Column:
            return F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))

        own = F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text").alias("text")))
        kept = F.when(F.col("edit") == "D", F.slice(own, 1, 0)).otherwise(own)
        turns = F.concat(empty(F.col("before")), kept, empty(F.col("behind")))
        return rows.join(self.edits(), ["bid", "place"]).select("conv_id", "bid", "place", "turn", "edit", turns.alias("turns"))

    def digests(self) -> DataFrame:
        """conv_id and the SHA-256 of the repaired ``role:text`` lines."""
        lines = F.transform("turns", lambda t: F.concat(t.role, F.lit(":"), t.text))
        rows = self.repaired().select("conv_id", "bid", "place", F.when(F.size("turns") > 0, F.array_join(lines, "\n")).alias("lines"))
        dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "bid", "place")
        conv = rows.schema["conv_id"].dataType.simpleString()
        return dealt.mapInArrow(_digested, f"conv_id {conv}, repaired_sha256 string")

    def report(self, originals: DataFrame) -> DataFrame:
        """For every conv_id of ``originals``, and of the rows: gaps, faults, illegal
        neighbours, cost, audit and digest. A conversation without rows has zeros, an
        empty audit and the digest of nothing. Gaps beyond a long are null."""
        faults = [F.count(F.when(F.col("fault") == k, 1)).alias(name) for k, name in ((_BLANK, "blank"), (_DUPLICATE, "duplicate"), (_TRUNCATED, "truncated"))]
        turns = [F.min("turn").alias("least"), F.max("turn").alias("most"), F.countDistinct("turn").alias("turns")]
        counts = self.rows.groupBy("conv_id").agg(*turns, *faults)
        gaps = F.when(F.col("turns") == 0, F.lit(0).cast("long")).otherwise(F.try_subtract(F.try_subtract("most", "least"), F.col("turns") - 1))
        audits = self.chosen.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("bid", "audit"))).alias("parts"))
        parts = [
            originals.select("conv_id").distinct(),
            counts.select("conv_id", F.lit(True).alias("found"), gaps.alias("gaps"), "blank", "duplicate", "truncated"),
            self.costs.select("conv_id", "illegal", "cost"),
            audits.select("conv_id", F.array_join("parts.audit", "").alias("audit")),
            self.digests(),
        ]
        whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        found = whole.groupBy("conv_id").agg(F.max("found").alias("found"), *[F.max(c).alias(c) for c in (*names, "audit", "repaired_sha256")])
        zero = F.lit(0).cast("long")
        nothing = F.lit(hashlib.sha256(b"").hexdigest())
        return found.select(
            "conv_id",
            F.when(F.col("found"), F.col("gaps")).otherwise(zero).alias("gaps"),
            *[F.coalesce(c, zero).alias(c) for c in names[1:]],
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
        )


def _entries(parts: Column) -> Column:
    """Blocks with the state at their entry: the first starts with nothing, each next one
    where the one before leaves."""
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<struct<bid: bigint, entry: int>>").alias("found"))

    def step(held: Column, part: Column) -> Column:
        one = F.array(F.struct(part.bid.alias("bid"), held.state.alias("entry")))
        return F.struct(F.element_at(part.leaves, held.state + 1).alias("state"), F.concat(held.found, one).alias("found"))

    return F.aggregate(parts, start, step, lambda held: held.found)
