"""Conversation repair against an enumeration of all edits."""

import hashlib
import re
import zlib
from functools import cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerspark.llm import repair

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """Cheapest and then ASCII-least of all edits, with up to two inserts in a gap."""
    kinds, best = faults(rows), (2 * len(rows), "D" * len(rows), [])

    def go(i, inserted, cost, audit, out):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows):
            if GRAMMAR.match("".join(r[:1] or "-" for r, _ in out)):
                best = min(best, (cost, audit, out))
        if inserted < 2:
            for role in ("user", "assistant"):
                go(i, inserted + 1, cost + 5, audit + "I", [*out, (role, "")])
        if i == len(rows):
            return
        (role, text), kind = rows[i], kinds[i]
        go(i + 1, 0, cost + 2, audit + "D", out)
        if kind in ("blank", "duplicate"):
            return
        more = 5 if kind == "truncated" else 0
        go(i + 1, 0, cost + more, audit + "K", [*out, (role, text)])
        for new in ("user", "assistant"):
            go(i + 1, 0, cost + 1 + more, audit + "R", [*out, (new, text)])

    go(0, 0, 0, "", [])
    return best


ROLES = ["system", "user", "assistant", "tool", ""]
ROWS = st.lists(st.tuples(st.sampled_from(ROLES), st.sampled_from(["a.", "b!", "c", " ", "d?\t"])), max_size=5)


def coded(rows):
    fault = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    return np.array([{"s": 0, "u": 1, "a": 2}.get(r[:1], 3) + 4 * fault[k] for (r, _), k in zip(rows, faults(rows))], np.uint8)


def in_blocks(codes, size):
    parts = [codes[a : a + size] for a in range(0, len(codes), size)]
    after, exits = repair._END, []
    for part in reversed(parts):
        exits.insert(0, after)
        after = np.minimum((repair._matrices([part])[0] + after).min(axis=1), repair._INF)
    ways, audits = repair.least_paths(parts, np.array(exits), np.array([k == len(parts) - 1 for k in range(len(parts))]))
    state, out = 0, ""
    for k in range(len(parts)):
        out += audits[k][state].decode()
        state = ways[k][state]
    return int(after[0]), out


@settings(max_examples=150, deadline=None)
@given(ROWS, st.integers(1, 6))
def test_least_of_all_edits(rows, size):
    if rows:
        assert in_blocks(coded(rows), size) == brute(rows)[:2]


def test_long_conversation_is_least_in_any_blocks():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 16, 5000).astype(np.uint8)
    assert in_blocks(codes, 5000) == in_blocks(codes, 64) == in_blocks(codes, 7)


def damaged(conv, rows):
    for turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text, draw = role if role is not None else " ", text if text is not None else " ", zlib.crc32(key.encode()) % 20
        if draw == 1:
            text = ""
        elif draw == 2:
            text = re.sub("[.!?]", "", text)
        elif draw == 4:
            role = "user"
        yield from [(turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)


@cache
def conversations():
    rng, out = np.random.default_rng(3), {}
    for conv in [*range(40), None, -7]:
        rows = []
        for turn in range(int(rng.integers(0, 5))):
            role = [*ROLES[:3], "user", "assistant", None][rng.integers(6)]
            rows.append((None if rng.integers(9) == 0 else turn + int(rng.integers(2)), role, [None, "", "é x.", "n", "ok!", "y? "][rng.integers(6)]))
        out[conv] = rows
    out[100] = [(0, "user", "hi."), (0, "user", "hi."), (0, "assistant", "yes."), (0, "assistant", "yes.")]
    out[101] = [(2**63 - 1, "user", "hi."), (-(2**63), "assistant", "x " * 50000)]
    return out


def plain(conv, rows):
    rows = sorted(damaged(conv, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    two = [(r, t) for _, r, t in rows]
    kinds = faults(two)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(two, two[1:])]
    cost, audit, out = brute(two)
    text = "\n".join(f"{r}:{t}" for r, t in out)
    counts = [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
    wrong = sum(p not in ("su", "ua", "au") for p in pairs)
    return (conv, gaps if gaps < 2**63 else None, *counts, wrong, cost, audit, hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("block", [2, repair.BLOCK_ROWS])
def test_report(spark, block):
    data = [(c, t, r, x, "other", 1) for c, rows in conversations().items() for t, r, x in rows]
    rows = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, bid string, cost int")
    got = {tuple(r) for r in repair.Repair(repair.damaged(rows), block).report(rows).collect()}
    assert got == {plain(c, rows) for c, rows in conversations().items() if rows}


def test_repaired_rows_and_empty_table(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame([(1, 0, "system", "be."), (1, 1, "assistant", "yes."), (1, 2, "assistant", "no.")], schema)
    found = repair.Repair(rows).repaired().orderBy("bid", "place").collect()
    assert [(r.edit, [tuple(t) for t in r.turns]) for r in found] == [("K", [("system", "be.")]), ("R", [("user", "yes.")]), ("K", [("assistant", "no.")])]
    none = spark.createDataFrame([], schema)
    assert repair.Repair(none).report(none).collect() == []
