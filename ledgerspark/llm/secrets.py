"""Secrets by a trigram inverted index over blocks of texts.

Each rule's regular expression is analysed once into a Boolean query over the
trigrams (of lower-cased text) that any match must contain. For each block of
texts, one pass over its bytes makes postings of all trigrams that some rule asks for;
queries intersect and unite them, and only candidates are verified by the expression.
Rules whose expression has no mandatory trigram scan every text. The index is of a
block, and isn't kept: each text is read once.

Null and empty texts have no spans. Repeated rows give repeated results. Very long
texts are scanned whole, in blocks of bounded bytes or a single text. An empty table
gives no rows. Other columns pass unchanged, whatever their names; one that has the
name of the result is replaced."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerspark.llm.common import SLICE_ROWS, lean, without

#: Strings a part of an expression may stand for, above which they aren't listed.
MOST_STRINGS = 24
#: Bytes of a block's texts above which each text is a block of its own.
BLOCK_BYTES = 1 << 24

BASE = ("assign", "access", "hex")
_FOLDED = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
RESULT = T.StructType(
    [T.StructField(f"n_{k}", T.LongType(), False) for k in BASE]
    + [T.StructField("base_sha256", T.StringType(), False), T.StructField("spans", T.StringType(), False)]
)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and how long a match (or one of its
    groups) must be. ``runs`` says that the expression is one class, repeated: its
    matches are whole runs, and the least length can stand in the expression itself."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    runs: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(f"{self.pattern[:-1]}{{{self.least},}}" if self.runs else self.pattern)


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The three base rules, then those that the method adds.
RULES = (
    Rule("assign", "(" + "|".join([*map(any_case, ("password", "passwd", "secret", "token")), any_case("api") + "_?" + any_case("key")]) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]+", 24, runs=True),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    Rule("host_token", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 24),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)


@dataclass
class Query:
    """None of both: every text. ``all_of`` trigrams and queries, or ``any_of``."""

    all_of: list = field(default_factory=list)
    any_of: list = field(default_factory=list)

    @property
    def always(self) -> bool:
        return not self.all_of and not self.any_of

    def trigrams(self) -> set[str]:
        return {t for x in (*self.all_of, *self.any_of) for t in ([x] if isinstance(x, str) else x.trigrams())}

    def matches(self, postings: dict[str, np.ndarray], everything: np.ndarray) -> np.ndarray:
        of = lambda x: postings[x] if isinstance(x, str) else x.matches(postings, everything)
        hit = everything
        for x in self.all_of:
            hit = hit & of(x)
        if self.any_of:
            some = np.zeros_like(everything)
            for x in self.any_of:
                some = some | of(x)
            hit = hit & some
        return hit


def _exact(words: set[str]) -> Query:
    each = []
    for w in words:
        grams = sorted({w[i : i + 3] for i in range(len(w) - 2)})
        if not grams:
            return Query()
        each.append(Query(all_of=grams))
    return each[0] if len(each) == 1 else Query(any_of=each)


def trigram_query(pattern: str) -> Query:
    """The trigrams that any match of the expression must contain."""

    def strings(op, arg) -> set[str] | None:
        """All strings that a part can match, lower-cased, if few."""
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.IN and all(o is C.LITERAL for o, _ in arg):
            return {chr(a).lower() for _, a in arg}
        if op is C.SUBPATTERN:
            return joined(arg[3])
        if op is C.BRANCH:
            parts = [joined(p) for p in arg[1]]
            return set().union(*parts) if None not in parts and sum(map(len, parts)) <= MOST_STRINGS else None
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 1:
            one = joined(arg[2])
            return None if one is None else one | ({""} if arg[0] == 0 else set())
        return None

    def joined(seq) -> set[str] | None:
        out = {""}
        for op, arg in seq:
            more = strings(op, arg)
            if more is None or len(out) * len(more) > MOST_STRINGS:
                return None
            out = {a + b for a in out for b in more}
        return out

    def needed(seq) -> Query:
        parts, run = [], {""}

        def close() -> None:
            nonlocal run
            parts.append(_exact(run))
            run = {""}

        for op, arg in seq:
            more = strings(op, arg)
            if more is not None and len(run) * len(more) <= MOST_STRINGS:
                run = {a + b for a in run for b in more}
                continue
            close()
            if more is not None:
                run = more
            elif op is C.SUBPATTERN:
                parts.append(needed(arg[3]))
            elif op is C.BRANCH:
                each = [needed(p) for p in arg[1]]
                parts.append(Query() if any(q.always for q in each) else Query(any_of=each))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
                parts.append(needed(arg[2]))
        close()
        parts = [p for p in parts if not p.always]
        return parts[0] if len(parts) == 1 else Query(all_of=parts)

    return needed(parser.parse(pattern))


class Scanner:
    """Finds all rules' spans in a block of texts."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.patterns = [r.compiled() for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.grams = sorted(set().union(*(q.trigrams() for q in self.queries)))
        self.place = np.zeros(1 << 24, np.uint8)  # a trigram's number, from 1; 0: not asked for
        for n, g in enumerate(self.grams, 1):
            a, b, c = g.encode("ascii")
            self.place[a << 16 | b << 8 | c] = n
        assert len(self.grams) < 256, "a byte numbers the trigrams"

    def postings(self, texts: pa.Array) -> np.ndarray:
        """For each trigram asked for (rows) and text (columns) whether it occurs, from
        one pass over the block's bytes. Only A-Z are folded: what lower-cases to
        ASCII in the rules is ASCII."""
        whole = pa.array(texts.to_pylist() if texts.null_count else texts, pa.large_string())
        ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
        found = np.zeros((len(self.grams) + 1, len(whole)), bool)
        if ends[-1] - ends[0] < 3:
            return found
        data = np.frombuffer(whole.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        data = _FOLDED[data].astype(np.uint32)
        number = self.place[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
        at = np.flatnonzero(number)
        text = np.searchsorted(ends - ends[0], at, "right") - 1
        inside = at + 2 < (ends - ends[0])[text + 1]
        found[number[at[inside]], text[inside]] = True
        return found

    def candidates(self, texts: pa.Array) -> list[np.ndarray]:
        """For each rule, whether a text of the block may have a match."""
        postings = dict(zip(self.grams, self.postings(texts)[1:]))
        everything = np.ones(len(texts), bool)
        return [q.matches(postings, everything) for q in self.queries]

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule number, end), in order of start."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        held: dict[int, str] = {}
        for k, (rule, pattern, hit) in enumerate(zip(self.rules, self.patterns, self.candidates(texts), strict=True)):
            for i in np.flatnonzero(hit).tolist():
                text = held[i] if i in held else held.setdefault(i, texts[i].as_py() or "")
                for m in pattern.finditer(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start(), k, m.end()))
        for spans in found:
            spans.sort()
        return found


def blocks(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Slices of some rows, of one row where their texts are long."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            small = part.column(at).nbytes <= BLOCK_BYTES
            yield from [part] if small else (part.slice(i, 1) for i in range(part.num_rows))


def listed(spans: Iterable[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES, kinds: int = len(RULES)) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans if k < kinds)


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """docs with a struct column of counts and spans (code points, end exclusive).
    Like withColumn, it replaces an existing column named ``out``."""
    base = without(docs, out)
    schema = T.StructType([*base.schema.fields, T.StructField(out, RESULT, False)])
    at = [c.lower() for c in base.columns].index(text_col.lower())
    names, kinds = schema.fieldNames(), list(to_arrow_schema(RESULT))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for part in blocks(batches, at):
            rows = scanner.scan(part.column(at))
            base_lists = [listed(r, kinds=len(BASE)) for r in rows]
            columns = [[sum(k == b for _, k, _ in r) for r in rows] for b in range(len(BASE))]
            columns += [[hashlib.sha256(x.encode()).hexdigest() for x in base_lists], [listed(r) for r in rows]]
            struct = pa.StructArray.from_arrays([pa.array(c, type=k.type) for c, k in zip(columns, kinds, strict=True)], fields=kinds)
            yield pa.RecordBatch.from_arrays([*part.columns, struct], names=names)

    return base.mapInArrow(lean(run), schema)


def without_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each secret's characters replaced by its kind in brackets;
    documents without one pass as they are. Overlapping spans are one."""
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for part in blocks(batches, at):
            texts = part.column(at)
            rows = scanner.scan(texts)
            if any(rows):
                new = [redacted(t.as_py(), r) if r else t.as_py() for t, r in zip(texts, rows, strict=True)]
                columns = part.columns
                columns[at] = pa.array(new, texts.type)
                part = pa.RecordBatch.from_arrays(columns, names=names)
            yield pa.RecordBatch.from_arrays(part.columns, names=names)

    return docs.mapInArrow(lean(run), docs.schema)


def redacted(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    out, done = [], 0
    for a, k, b in spans:
        if b <= done:
            continue
        if a >= done:
            out += [text[done:a], f"[{rules[k].kind}]"]
        done = b
    return "".join([*out, text[done:]])
