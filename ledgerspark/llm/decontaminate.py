"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to words of letters, digits and characters beyond ASCII, in
lower case, one space apart. The automaton holds every window of ten consecutive
words of every benchmark text (a shorter text is one window) and scans each
document once; ends of matches give words, words give offsets in the original.

The benchmark is held in blocks of bounded size: what one block needs is sent to
the workers, and a larger benchmark means more passes, never a larger automaton.

Null texts have no words. Items without words match nothing. Repeated rows give
repeated results. An empty benchmark leaves every document clean; an empty table of
documents gives no rows. Very long texts are scanned whole, one at a time. Other columns
pass unchanged, whatever their names; one that has the name of the result is replaced."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerspark.llm.common import SLICE_ROWS, lean, without

WINDOW = 10
#: Characters of benchmark texts in one automaton.
BLOCK_CHARS = 4_000_000

#: Every byte that isn't part of a word becomes a space; capitals are folded.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")

SPAN = T.StructType([T.StructField("start", T.LongType(), False), T.StructField("end", T.LongType(), False)])
SCAN = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("words", T.ArrayType(SPAN, False), False),
        T.StructField("spans", T.ArrayType(SPAN, False), False),
        T.StructField("items", T.ArrayType(T.StringType(), False), False),
    ]
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def patterns_of(items: Iterable[tuple[str, str | None]]) -> dict[bytes, tuple[int, set[str]]]:
    """Windows (words one space apart, a space at both ends) with their number of
    words and the items that have them."""
    out: dict[bytes, tuple[int, set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        for at in range(max(1, len(words) - WINDOW + 1)) if words else ():
            window = words[at : at + WINDOW]
            out.setdefault(b" " + b" ".join(window) + b" ", (len(window), set()))[1].add(item)
    return out


class Scan:
    """Hits of one block of the benchmark in a text."""

    def __init__(self, patterns: dict[bytes, tuple[int, set[str]]]) -> None:
        self.found = ahocorasick.Automaton()
        for key, value in patterns.items():
            self.found.add_word(key.decode("latin-1"), value)
        self.any = bool(patterns)
        if self.any:
            self.found.make_automaton()

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (end exclusive, merged) and the items found."""
        if not self.any or not words:
            return [], set()
        matches = list(self.found.iter((b" " + b" ".join(words) + b" ").decode("latin-1")))
        if not matches:
            return [], set()
        ends = np.cumsum([len(w) + 1 for w in words])
        last = np.searchsorted(ends, [m[0] for m in matches])
        runs: list[tuple[int, int]] = []
        for a, b in sorted((int(k) - m[1][0] + 1, int(k) + 1) for k, m in zip(last, matches)):
            if runs and a <= runs[-1][1]:
                runs[-1] = runs[-1][0], max(b, runs[-1][1])
            else:
                runs.append((a, b))
        return runs, set().union(*(m[1][1] for m in matches))


def merged(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1] = out[-1][0], max(y, out[-1][1])
        else:
            out.append((x, y))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_chars: int) -> list[DataFrame]:
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    return [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b) for b in range(n)] if n > 1 else [items]


def scan_benchmark(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    out: str = "scan", block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """docs with a struct column: number of words, runs of hit words, their spans in
    the original text (code points), and the items found."""
    base = without(docs, out)
    spark = docs.sparkSession
    schema = T.StructType([*base.schema.fields, T.StructField(out, SCAN, False)])
    at = [c.lower() for c in base.columns].index(text_col.lower())
    names, kinds = schema.fieldNames(), list(to_arrow_schema(SCAN))
    blocks = _blocks(benchmark, item_id, item_text, block_chars)
    for b, block in enumerate(blocks):
        held = spark.sparkContext.broadcast(patterns_of((r.item, r.text) for r in block.collect()))
        first, last = b == 0, b == len(blocks) - 1

        def run(batches: Iterable[pa.RecordBatch], held=held, first=first, last=last) -> Iterator[pa.RecordBatch]:
            scan = Scan(held.value)
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE_ROWS):
                    part = batch.slice(start, SLICE_ROWS)
                    before = [None] * part.num_rows if first else part.column(part.num_columns - 1).to_pylist()
                    rows = []
                    for text, old in zip(part.column(at), before):
                        words = words_of(text := text.as_py())
                        runs, items = scan.hits(words)
                        if old:
                            runs = merged(runs, [(r["start"], r["end"]) for r in old["words"]])
                            items = items | set(old["items"])
                        spans = []
                        if last and runs:
                            places = [m.span() for m in _WORD.finditer(text)]
                            spans = [{"start": places[x][0], "end": places[y - 1][1]} for x, y in runs]
                        rows.append((len(words), [{"start": x, "end": y} for x, y in runs], spans, sorted(items)))
                    values = [pa.array([r[i] for r in rows], type=k.type) for i, k in enumerate(kinds)]
                    keep = part.columns if first else part.columns[:-1]
                    yield pa.RecordBatch.from_arrays([*keep, pa.StructArray.from_arrays(values, fields=kinds)], names=names)

        base = base.mapInArrow(lean(run), schema)
    return base


def n_hit(scan: str = "scan") -> Column:
    return F.aggregate(F.col(f"{scan}.words"), F.lit(0).cast("long"), lambda n, r: n + r.end - r.start)
