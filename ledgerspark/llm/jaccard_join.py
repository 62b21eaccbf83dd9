"""N-gram Jaccard join by universe partition and pigeonhole.

A document's set is its distinct word shingles. Two sets link when
100 * |intersection| >= percent * |union|, which bounds their symmetric difference.
Sets are handled in bands of sizes. In each band the universe of shingles is hashed
into segments, in a fixed order. A segment is worth 1 (looked up as a whole) or 2
(looked up with its one-deletion neighbourhood, which finds segments at most one
shingle apart); the band takes what costs less, rows and chance matches together. A
set indexes its first segments only, until their worths exceed the most that any
partner of its size can differ by; empty segments count nothing. Of two sets that
link, the one that stops first can't have lost all of its segments to differences, so
both hold a common key. Candidates are verified on their whole shingle sets.

Near copies come in groups, so matches are never expanded into pairs. Equal sets are
one class. Every class of a key is held against the key's hub, the class with the most
matched keys, and links give components. Keys that still hold several components are
stars of open pairs. A star of many sets, as boilerplate makes them, is split by how its
sets differ from what most of them hold: sets that link, but for certain links with the
one nearest to that, differ from it alike somewhere, so such shingles are keys of smaller
stars. Small stars are compared inside cells of bounded size: parities of shingles rule
out pairs there, and a cell returns at most as many links as it has sets. No link between
components is lost; links inside one need not be listed.

Null, empty and blank texts have an empty set and link with nothing: their component
is their own doc_id. Repeated rows are repeated members of a class; each row of a
doc_id that occurs with several texts is judged by its own text, and rows with a null
doc_id like all others; null is never the smallest. Ties don't occur: the smallest id
is unique. An empty table gives no rows. Very long texts are processed whole, one at a
time. Only the id and text columns are read, whatever else the table holds. Words are
split at ASCII white space and A-Z are folded. A set is known by a 128-bit digest of
its sorted 64-bit shingle hashes."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.llm.common import SLICE_ROWS, lean, written

#: Growth of a band's sizes; a power of two above every band's number.
BAND, BANDS = 1.7, 64
#: Segments beyond those that the worths need, as a share; they make up for empty ones.
SPARE = 1.06
#: Sets expected to share one given shingle of a segment, and the share of these that
#: have one more given shingle of it: the cost of chance matches.
SHARING, MORE = 100.0, 0.2
#: Sets and shingles of a cell on average, at most.
FEW, CELL_SHINGLES = 500, 250_000
#: Stars of more than SPLIT * FEW sets are split, LEVELS times at most; smaller ones make at
#: most 2 * SPLIT cell rows a set. Sets of which a star's core is taken, about.
SPLIT, LEVELS, CORE_SETS = 8, 6, 48
#: Least bits of a set's sketch.
SKETCH_BITS = 512
#: Rows of at most 64 bytes up to which a list of sets or rows is broadcast; a longer
#: one is joined by shuffles.
BROADCAST_ROWS = 500_000
#: Bytes of a word, and numbers of words, that a task remembers.
WORD_BYTES, WORDS = 64, 200_000

_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


class Words:
    """Numbers of words, the same in every process; remembers them in bounds."""

    def __init__(self, most: int = WORDS) -> None:
        import xxhash

        self.of, self.most, self.known = xxhash.xxh3_64_intdigest, most, {}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.most:
            known.clear()
        found = list(map(known.get, words))
        if None in found:
            for i, (w, n) in enumerate(zip(words, found)):
                if n is None:
                    found[i] = n = self.of(w)
                    if len(w) <= WORD_BYTES:
                        known[w] = n
        return np.array(found, np.uint64)


def shingles(text: str | None, words: Words, k: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit numbers."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not found:
        return np.empty(0, np.uint64)
    w = words.numbers(found)
    width = min(k, len(w))
    n = len(w) - width + 1
    h, factor = np.full(n, np.uint64(width)), 1
    for i in range(width):
        factor = factor * int(_C[0]) & 0xFFFFFFFFFFFFFFFF
        h += w[i : i + n] * np.uint64(factor)
    h = mix(h)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def set_id(tokens: np.ndarray) -> bytes:
    """A digest of a set; equal sets have equal ones."""
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes())


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parities of the shingles in as many places as there are shingles, rounded up
    to a power of two. Each shingle that two sets don't share changes one bit, so bits
    that differ never outnumber those shingles: too many of them rule a link out for
    certain. A sketch of fixed width would fill up and rule out nothing for large sets."""
    width = max(SKETCH_BITS, 1 << (len(tokens) - 1).bit_length())
    bits = np.bincount((mix(tokens ^ _C[0]) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def may_link(size_a, size_b, sketch_a, sketch_b, percent: int):
    """Whether sizes and sketches allow a link; never false for sets that link. Sizes
    that do have, from 50 percent on, sketches of one width, or one of twice the
    other's: the wider is folded, its halves' parities added."""
    n, most = F.least(F.size(sketch_a), F.size(sketch_b)), F.greatest(F.size(sketch_a), F.size(sketch_b))

    def folded(sketch):
        return F.when(F.size(sketch) > n, F.zip_with(F.slice(sketch, F.lit(1), n), F.slice(sketch, n + 1, n), lambda x, y: x.bitwiseXOR(y))).otherwise(sketch)

    differ = F.aggregate(F.zip_with(folded(sketch_a), folded(sketch_b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    sizes = F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * percent
    return sizes & F.when(most > 2 * n, F.lit(True)).otherwise(differ * (100 + percent) <= (100 - percent) * (size_a + size_b))


def differ(a: int, b: int, percent: int) -> int:
    """The greatest symmetric difference of sets of these sizes that link."""
    return (100 - percent) * (a + b) // (100 + percent)


def band_of(size: int) -> int:
    return int(math.log(size) / math.log(BAND) + 1e-9)


@functools.cache
def band_limits(band: int) -> tuple[int, int]:
    """Least and greatest size of a band."""
    low, high = max(1, int(BAND**band) - 2), int(BAND ** (band + 1)) + 2
    sizes = [s for s in range(low, high + 1) if band_of(s) == band]
    return (sizes[0], sizes[-1]) if sizes else (0, -1)


@functools.cache
def allocation(band: int, percent: int) -> tuple[int, int, int]:
    """Worth of the band's segments, their number, and the largest partner's size.

    All worths together exceed the difference of any two sets that link and of which
    the smaller is in the band. Cost is, for a set in the middle, a row for each key,
    and for each key the sets that chance has under it; a key of a deletion
    neighbourhood has one shingle less. So worth 2, with twice the shingles a segment
    and as many more rows, suits bands of small sets or high thresholds."""
    low, high = band_limits(band)
    partner = high * 100 // percent
    most, middle = differ(high, partner, percent) + 1, (low + high) // 2
    need = differ(middle, middle * 100 // percent, percent) + 1
    best: tuple[float, int, int] | None = None
    for worth in (1, 2):
        segments = math.ceil(most / worth * SPARE)
        each = middle / segments
        rows = need / worth * (1 + each * (worth - 1))
        cost = rows * (1 + SHARING * MORE ** (each - worth + 1))
        if best is None or cost < best[0]:
            best = cost, worth, segments
    return best[1], best[2], partner


def signatures(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set: in its own band, and in each lower band whose sets it may
    link with. A key names band (its low bits), segment and the segment's shingles (or
    all but one).

    A set whose segments hold too few worths, as too many are empty, takes all of
    them, empty ones too: two such sets can match in those only."""
    size = len(tokens)
    if not size:
        return np.empty(0, np.uint64)
    out, own, hashed = [], band_of(size), mix(tokens ^ _C[2])
    for band in range(own, -1, -1):
        low, high = band_limits(band)
        if high < low:
            continue
        worth, segments, partner = allocation(band, percent)
        if size > partner:
            break
        need = differ(size, size * 100 // percent if band == own else high, percent) + 1
        place = (mix(tokens + mix(np.array([band + 1], np.uint64))) % np.uint64(segments)).astype(np.int64)
        count = np.bincount(place, minlength=segments)
        total = np.zeros(segments, np.uint64)
        np.add.at(total, place, hashed)
        worths = np.cumsum(np.minimum(count, worth))
        short = worths[-1] < need
        last = segments if short else int(np.searchsorted(worths, need)) + 1
        salt = mix(np.arange(last, dtype=np.uint64) + mix(np.array([band], np.uint64)))
        found = [mix(total[:last] ^ salt)[(count[:last] > 0) | short]]
        if worth == 2:
            inside = (place < last) & ((count[place] > 1) | short)
            where = place[inside]
            found.append(mix((total[where] - hashed[inside]) ^ salt[where]))
        out += [(f & ~np.uint64(BANDS - 1)) | np.uint64(band) for f in found]
    return np.unique(np.concatenate(out))


class Sketches:
    """Sizes and sketches of the sets of a cell, to hold others against."""

    def __init__(self, sizes: np.ndarray, sketches: list[np.ndarray], percent: int) -> None:
        self.sizes, self.percent, self.by = sizes, percent, {}
        widths = np.array([len(s) for s in sketches])
        for width in np.unique(widths):
            at = np.flatnonzero(widths == width)
            self.by[int(width)] = at, np.stack([sketches[i] for i in at]).view(np.uint64)

    def near(self, size: int, own: np.ndarray, also: np.ndarray) -> np.ndarray:
        """Places of the sets for which ``also`` is true and which may link with one."""
        p, out = self.percent, []
        fits = also & (100 * np.minimum(size, self.sizes) >= p * np.maximum(size, self.sizes))
        for width, (at, matrix) in self.by.items():
            mine = fits[at]
            if not mine.any():
                continue
            at, some, x = at[mine], matrix[mine], own.view(np.uint64)
            if width == 2 * len(own):
                some = some[:, : len(own)] ^ some[:, len(own) :]
            elif len(own) == 2 * width:
                x = x[:width] ^ x[width:]
            if some.shape[1] == len(x):
                apart = np.bitwise_count(some ^ x).sum(1, dtype=np.int64)
                at = at[apart * (100 + p) <= (100 - p) * (size + self.sizes[at])]
            out.append(at)
        return np.concatenate(out) if out else np.empty(0, np.int64)


def _fields(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


SIGNED = "doc_id long, t1 long, t2 long, n_shingles long, set_id binary, node long, sketch array<long>, keys array<long>"
CELL = ["hub", "i", "j"]


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, two hashes that name the text, and the text."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"), text.alias("text"))


def signed_sets(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Each row's set: size, digest, the digest's first half, sketch and keys. A task
    gives the keys of a set once, as long as it remembers having met it."""
    schema = _fields(SIGNED)

    def lists(found: list[np.ndarray]) -> pa.Array:
        ends = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
        values = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, none = Words(), set(), np.empty(0, np.uint64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                sizes, ids, sketches, keys = [], [], [], []
                for text in part.column(3):
                    tokens = shingles(text.as_py(), words, k)
                    mine = set_id(tokens)
                    sizes.append(len(tokens))
                    ids.append(mine)
                    sketches.append(sketch(tokens))
                    keys.append(none if mine in seen else signatures(tokens, percent))
                    seen.add(mine)
                if len(seen) > WORDS:
                    seen.clear()
                nodes = np.frombuffer(b"".join(ids), np.int64)[::2]
                columns = [part.column(0), part.column(1), part.column(2), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(nodes), lists(sketches), lists(keys)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return rows.mapInArrow(lean(run), schema)


def in_cells(rows: DataFrame) -> DataFrame:
    return rows.repartition(*CELL).sortWithinPartitions(*CELL)


def each_cell(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """The cells of sorted rows, one at a time, with their first three columns' values."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = [batch.column(i).to_numpy() for i in range(3)]
        new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in at], axis=0)) + 1
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
            mine = tuple(int(x[lo]) for x in at)
            if held and mine != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = mine
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield key, pa.Table.from_batches(held)


def possible_sets(cells: DataFrame, percent: int) -> DataFrame:
    """Of cells of (hub, i, j, outer, set_id, component, size, sketch): the rows of sets
    that sizes and sketches leave a partner on the cell's other side."""
    schema = _fields("hub long, i long, j long, outer boolean, set_id binary, component long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in each_cell(batches):
            outer, part, sizes = rows["outer"].to_numpy(), rows["component"].to_numpy(), rows["size"].to_numpy()
            sketches = [np.asarray(s, np.int64) for s in rows["sketch"].to_pylist()]
            inner = np.flatnonzero(~outer)
            if not len(inner) or (part == part[0]).all():
                continue
            others, found = Sketches(sizes[inner], [sketches[i] for i in inner], percent), np.zeros(len(outer), bool)
            for o in np.flatnonzero(outer):
                near = others.near(sizes[o], sketches[o], part[inner] != part[o])
                found[o] |= len(near) > 0
                found[inner[near]] = True
            if found.any():
                kept = rows.select(schema.fieldNames()).take(pa.array(np.flatnonzero(found))).combine_chunks()
                yield from kept.to_batches()

    return in_cells(cells).mapInArrow(lean(run), schema)


def links_in_cells(cells: DataFrame, k: int, percent: int) -> DataFrame:
    """Of cells of (hub, i, j, outer, set_id, component, text): links (a, b) between an
    outer and an inner set of different components, on their whole sets; a null
    component is the set's own. A cell's
    components are joined as links are found, so it returns fewer links than it has sets."""
    schema = _fields("a binary, b binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for _, rows in each_cell(batches):
            outer, ids, found = rows["outer"].to_numpy(), rows["set_id"].to_pylist(), []
            part = np.array([-1 - n if x is None else x for n, x in enumerate(rows["component"].to_pylist())])
            sets = [shingles(text.as_py(), words, k) for text in rows["text"]]
            assert all(set_id(s) == i for s, i in zip(sets, ids)), "a text isn't that of its set"
            sizes, inner = np.array([len(s) for s in sets]), np.flatnonzero(~outer)
            if not len(inner):
                continue
            others = Sketches(sizes[inner], [sketch(sets[i]) for i in inner], percent)
            for o in np.flatnonzero(outer):
                for n in inner[others.near(sizes[o], sketch(sets[o]), part[inner] != part[o])]:
                    if part[n] == part[o]:
                        continue
                    both = len(np.intersect1d(sets[o], sets[n], assume_unique=True))
                    if 100 * both >= percent * (sizes[o] + sizes[n] - both):
                        found.append((ids[o], ids[n]))
                        part[part == part[n]] = part[o]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], names=schema.fieldNames())

    return in_cells(cells).mapInArrow(lean(run), schema)


def bounded(rows: DataFrame) -> DataFrame:
    """Written rows, to be broadcast if there are few of them."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def with_texts(cells: DataFrame, owners: DataFrame, rows: DataFrame, *more: str) -> DataFrame:
    """Cells with one text of each set, and the columns ``more``; only the texts that
    cells need are shuffled."""
    needed = owners.join(cells.select("set_id").distinct(), "set_id", "left_semi").select("set_id", "t1", "t2")
    found = rows.select("t1", "t2", "text").join(bounded(written(needed, "needed")), ["t1", "t2"])
    texts = written(found.groupBy("set_id").agg(F.min("text").alias("text")), "texts")
    return cells.join(texts, "set_id").select(*CELL, "outer", "set_id", "component", "text", *more)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of what edges (a, b) touch: the smallest id reachable. Each
    round passes the least label along the edges and then to labels of labels; rounds
    are written, so that none recomputes those before."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    touched = both.groupBy("a").agg(F.min("b").alias("b"))
    labels = written(touched.select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        jump = step.join(labels.select(F.col("id").alias("next"), F.col("label").alias("far")), "next", "left")
        least = F.least("next", F.coalesce("far", "next"))
        new = written(jump.select("id", least.alias("label"), (F.col("label") != least).alias("moved")), "labels")
        labels = new.select("id", "label")
        if not new.where("moved").limit(1).count():
            return labels.withColumnRenamed("label", "component")


def matched_keys(signed: DataFrame) -> DataFrame:
    """(key, hub, node) of the keys that several sets hold. The hub of a key is the node
    with the most such keys. Counts and hubs are aggregates, which combine before
    they are shuffled, and are joined back as written tables, so that Spark can split
    a key that very many sets hold."""
    keys = signed.select(F.explode("keys").alias("key"), "node")
    several = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key")
    raw = written(keys.join(written(several, "keys"), "key"), "matches")
    once = written(raw.distinct(), "matches")
    score = written(once.groupBy("node").agg(F.count("*").alias("score")), "scores")
    best = once.join(score, "node").groupBy("key").agg(F.max(F.struct("score", "node")).alias("best"))
    hubs = written(best.select("key", F.col("best.node").alias("hub")), "hubs")
    return written(once.join(hubs, "key").where("hub <> node"), "hubbed")


def star_cells(stars: DataFrame) -> DataFrame:
    """Cells of the pairs (hub, set): each hub with a bounded part of its sets."""
    parts = written(stars.groupBy("hub", "a").agg(F.greatest(F.ceil(F.count("*") / FEW), F.ceil(F.sum("size") / CELL_SHINGLES)).alias("parts")), "parts")
    own = parts.select("hub", F.lit(0).cast("long").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("j"), F.lit(True).alias("outer"), F.col("a").alias("set_id"), F.lit(None).cast("long").alias("component"))
    member = stars.join(parts, ["hub", "a"]).select(
        "hub", F.lit(0).cast("long").alias("i"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("j"), F.lit(False).alias("outer"), F.col("b").alias("set_id"), F.lit(None).cast("long").alias("component"),
    )
    return own.unionByName(member)


def open_stars(hubbed: DataFrame, owners: DataFrame, labels: DataFrame) -> DataFrame:
    """What can still hide a link between components: (hub, set_id, size, sketch,
    component, away), the sets of one hub that share a key of several components. A set
    is away if its component isn't the hub's; every open pair has one that is."""
    sides = owners.join(labels.withColumnRenamed("id", "set_id"), "set_id", "left")
    number = F.conv(F.substring(F.hex(F.coalesce("component", "set_id")), 1, 15), 16, 10).cast("long")
    sides = written(sides.select("node", "set_id", "size", "sketch", number.alias("component")), "sides")
    of_node = sides.groupBy("node").agg(F.min("component").alias("component"), F.max("component").alias("other"))
    placed = written(hubbed.join(of_node, "node"), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("least"), F.max(F.greatest("component", "other")).alias("most")).where("least <> most").select("key")
    stars = written(placed.join(written(mixed, "mixed"), "key").select("hub", "node").distinct(), "open")
    home = of_node.select(F.col("node").alias("hub"), F.col("component").alias("home"))
    rows = stars.join(home, "hub").join(sides, "node")
    return written(rows.select("hub", "set_id", "size", "sketch", "component", (F.col("component") != F.col("home")).alias("away")), "stars")


def open_cells(rows: DataFrame) -> DataFrame:
    """Cells of stars: each star's sets that are away are held against all its sets, in
    cells of so many of either."""
    of = lambda n, size: F.greatest(F.ceil(n / FEW), F.ceil(size / CELL_SHINGLES), F.lit(1))
    away = F.col("away").cast("long")
    parts = rows.groupBy("hub").agg(of(F.count("*"), F.sum("size")).alias("js"), of(F.sum(away), F.sum(away * F.col("size"))).alias("is"), F.max("away").alias("any"))
    rows = rows.join(written(parts.where("any"), "parts"), "hub")
    spot, each = (lambda n: F.pmod(F.xxhash64("set_id"), F.col(n))), (lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    columns = ["set_id", "component", "size", "sketch"]
    outer = rows.where("away").select("hub", spot("is").alias("i"), each("js").alias("j"), F.lit(True).alias("outer"), *columns)
    inner = rows.select("hub", each("is").alias("i"), spot("js").alias("j"), F.lit(False).alias("outer"), *columns)
    return outer.unionByName(inner)


def residues(rows: DataFrame, owners: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(hub, token, set_id, component, slack): how the sets of stars differ from what
    most sets of their star hold, a row a shingle, and a row with a null token for the
    set itself. The core is what more than half of a sample of the star's sets hold; any
    core gives whole results, a common one gives few rows. A set's slack is
    (100 + percent) * differing shingles - (100 - percent) * its size."""
    counts = rows.groupBy("hub").agg(F.count("*").alias("n"), F.greatest(F.ceil(F.count("*") / FEW), F.ceil(F.sum("size") / CELL_SHINGLES)).alias("parts"))
    placed = rows.join(bounded(written(counts, "star-parts")), "hub")
    cell = [F.col("hub"), F.lit(0).cast("long").alias("i"), F.pmod(F.xxhash64("set_id"), F.col("parts")).alias("j"), F.lit(False).alias("outer"), F.col("set_id"), F.col("component")]
    drawn = F.pmod(F.xxhash64("set_id", F.lit(7)), F.ceil(F.col("n") / CORE_SETS)) == 0
    whole = written(with_texts(placed.select(*cell, drawn.alias("drawn")), owners, texts, "drawn"), "star-texts")

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for hub, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = shingles(text.as_py(), words, k).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), hub), pa.int64()), pa.array(found)], names=["hub", "token"])

    sample = whole.where("drawn").select("hub", "text")
    held = sample.mapInArrow(lean(tokens), "hub long, token long").groupBy("hub", "token").agg(F.count("*").alias("n"))
    drawn_sets = sample.groupBy("hub").agg(F.count("*").alias("sets"))
    core = held.join(F.broadcast(drawn_sets) if counts.count() <= BROADCAST_ROWS else drawn_sets, "hub").where("2 * n > sets").groupBy("hub").agg(F.collect_list("token").alias("core"))
    own = counts.join(core, "hub", "left").select(
        "hub", F.lit(0).cast("long").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("j"), F.lit(True).alias("outer"),
        F.coalesce("core", F.array().cast("array<long>")).alias("core"),
    )
    cells = whole.select(*CELL, "outer", "set_id", "component", "text").unionByName(own, allowMissingColumns=True)
    schema = _fields("hub long, token long, set_id binary, component long, slack long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for (hub, _, _), table in each_cell(batches):
            outer = table["outer"].to_numpy()
            middle = np.sort(np.array(table["core"][int(np.flatnonzero(outer)[0])].as_py(), np.int64).view(np.uint64))
            table = table.filter(pa.array(~outer))
            sets = [shingles(text.as_py(), words, k) for text in table["text"]]
            for start in range(0, len(sets), SLICE_ROWS):
                some = sets[start : start + SLICE_ROWS]
                apart = [np.setxor1d(x, middle, assume_unique=True).view(np.int64) for x in some]
                slacks = [(100 + percent) * len(d) - (100 - percent) * len(x) for x, d in zip(some, apart)]
                at = np.repeat(np.arange(len(some)), [len(d) + 1 for d in apart])
                tokens = np.concatenate([np.concatenate(([0], d)) for d in apart])
                itself = np.concatenate(([True], at[1:] != at[:-1]))
                part = table.slice(start, len(some)).take(pa.array(at)).combine_chunks()
                columns = [pa.array(np.full(len(at), hub)), pa.array(tokens, mask=itself), part["set_id"].combine_chunks(), part["component"].combine_chunks(), pa.array(np.array(slacks)[at])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return written(in_cells(cells).mapInArrow(lean(run), schema), "residues")


def split_stars(rows: DataFrame, owners: DataFrame, texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that are certain, and smaller stars for all others.

    With C any set, A and B differ in no more than A and C and B and C together. If
    the slacks of two sets add up to nothing or less, they link, and so does either with
    the set of least slack: these links are returned. If they add up to more, the sets can
    link only where they differ from C alike, in one shingle at least: the sets of a star
    that share such a shingle are a new star. Stars of the same sets are taken once."""
    apart = residues(rows, owners, texts, k, percent)
    single = apart.where("token IS NULL")
    near = single.groupBy("hub").agg(F.min(F.struct("slack", "set_id", "component")).alias("x"))
    near = near.select("hub", F.col("x.set_id").alias("a"), F.col("x.slack").alias("least"), F.col("x.component").alias("home")).where("least <= 0")
    certain = single.join(bounded(written(near, "nearest")), "hub").where("slack + least <= 0 AND component <> home").select("a", F.col("set_id").alias("b"))
    shared = apart.where("token IS NOT NULL").groupBy("hub", "token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "set_id")).alias("y"),
        F.min("component").alias("home"), F.max("component").alias("most"),
    )
    once = shared.where("home <> most").groupBy("hub", "n", "x", "y").agg(F.min("token").alias("token"), F.min("home").alias("home"))
    once = bounded(written(once.select("hub", "token", "home"), "shared"))
    found = apart.join(once, ["hub", "token"]).select(F.xxhash64("hub", "token").alias("hub"), "set_id", "component", (F.col("component") != F.col("home")).alias("away"))
    found = found.join(owners.select("set_id", "size", "sketch"), "set_id")
    return written(certain, "certain"), written(found.select("hub", "set_id", "size", "sketch", "component", "away"), "stars")


def open_work(rows: DataFrame, owners: DataFrame, texts: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """Cells for all open stars, and links that are certain. Large stars are split until
    they are small; what is large after all LEVELS is held against itself in cells."""
    cells, links = [], None
    for _ in range(LEVELS):
        large = written(rows.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") > SPLIT * FEW).select("hub"), "large")
        if not large.limit(1).count():
            break
        cells.append(open_cells(rows.join(bounded(large), "hub", "left_anti")))
        certain, rows = split_stars(rows.join(bounded(large), "hub"), owners, texts, k, percent)
        links = certain if links is None else links.union(certain)
    return functools.reduce(DataFrame.unionByName, [*cells, open_cells(rows)]), links


def classed_rows(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """One row per document: doc_id, t1, t2, n_shingles, set_id and component, the
    number of its group; null for an empty set."""
    rows = text_rows(docs, id_col, text_col)
    signed = written(signed_sets(rows, k, percent), "sets")
    hubbed = matched_keys(signed)

    named = hubbed.select("node").union(hubbed.select("hub")).distinct()
    # Combined before the join, so that a set that very many rows have is one row there.
    sets = signed.where("n_shingles > 0").groupBy("node", "set_id").agg(F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.min(F.struct("t1", "t2")).alias("t"))
    owners = sets.join(written(named, "named"), "node", "left_semi")
    owners = written(owners.select("node", "set_id", "size", "sketch", "t.t1", "t.t2"), "owners")

    # Each set against the hubs of its keys.
    a = owners.select(F.col("node").alias("hub"), F.col("set_id").alias("a"), F.col("size").alias("_a"), F.col("sketch").alias("_x"))
    b = owners.select("node", F.col("set_id").alias("b"), "size", F.col("sketch").alias("_y"))
    stars = hubbed.select("hub", "node").distinct().join(b, "node").join(a, "hub")
    stars = written(stars.where(may_link(F.col("_a"), F.col("size"), F.col("_x"), F.col("_y"), percent)).select("hub", "a", "b", "size"), "pairs")
    edges = written(links_in_cells(with_texts(star_cells(stars), owners, rows), k, percent), "links")
    labels = components(edges)

    # Then what can still hide a link between components.
    cells, certain = open_work(open_stars(hubbed, owners, labels), owners, rows, k, percent)
    left = written(possible_sets(cells, percent), "possible")
    more = certain
    if left.limit(1).count():
        found = written(links_in_cells(with_texts(left, owners, rows), k, percent), "links")
        more = found if more is None else more.union(found)
    if more is not None and more.limit(1).count():
        labels = components(edges.union(more))

    classed = signed.select("doc_id", "t1", "t2", "n_shingles", "set_id").join(labels.withColumnRenamed("id", "set_id"), "set_id", "left")
    return classed.withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "set_id")))


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """One row per document: doc_id, n_shingles and component_id, the smallest
    doc_id reachable over links."""
    classed = written(classed_rows(docs, id_col, text_col, k, percent).select("doc_id", "n_shingles", "component"), "classed")
    smallest = classed.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    several = written(smallest.where("n > 1").select("component", "component_id"), "smallest")
    return classed.join(several, "component", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """One row of docs of each component, and every row of an empty set.

    The row kept is that of the smallest doc_id, null last; of one doc_id, that of the
    least hashes of the text, then of the least values of all columns. All columns
    pass, whatever their names."""
    row = ["doc_id", "t1", "t2"]
    found = written(classed_rows(docs, id_col, text_col, k, percent).where("component IS NOT NULL").select(*row, "component"), "classed")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), *row)
    groups = found.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = written(groups.select("component", F.col("first.doc_id").alias("id"), F.col("first.t1").alias("x"), F.col("first.t2").alias("y")), "groups")
    is_first = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("t1") == F.col("x")) & (F.col("t2") == F.col("y"))
    judged = found.join(groups, "component").select(*row, is_first.alias("first"))
    judged = written(judged.groupBy(*row).agg(F.max("first").alias("first"), F.count("*").alias("n")).where("NOT first OR n > 1"), "judged")

    text = F.col(f"d.`{text_col}`")
    mine = F.col(f"d.`{id_col}`").cast("long"), F.xxhash64(text), F.xxhash64(F.lit(1), text)
    of = lambda rows: bounded(rows.select(*row)).alias("m")
    other = F.col("m.doc_id")
    same = F.coalesce(mine[0], F.lit(0)).eqNullSafe(F.coalesce(other, F.lit(0))) & (mine[0].isNull() == other.isNull()) & (mine[1] == F.col("m.t1")) & (mine[2] == F.col("m.t2"))
    left = docs.alias("d").join(of(judged), same, "left_anti")
    again = judged.where("first")
    if not again.limit(1).count():
        return left
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    repeated = docs.alias("d").join(of(again), same).groupBy(*[F.col(f"m.{c}").alias(f"_{c}") for c in row]).agg(F.min(F.struct(*columns)).alias("_row"))
    return left.union(repeated.select("_row.*"))
