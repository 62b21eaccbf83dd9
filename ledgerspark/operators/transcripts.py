"""Transcripts made of parts, and windows over long ones (inventory W3 to W6)."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.text import bound, estimated_tokens

STITCHED = "struct<pieces:array<string>,tail:array<string>,reach:double,n_overlaps:bigint,dropped:bigint>"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def stitched(parts: DataFrame, key: str, most: int = 8, per_second: float = 5.0) -> DataFrame:
    """Each key's parts (start, end, index, text) as one text, without the words that
    parts which overlap in time say twice: (key, text, n_overlaps, dropped, skipped).

    Dropped is the longest run of 2 to ``most`` words that ends what is merged so far and
    begins the next part, no more than the overlap has time for; without an overlap in
    time nothing is. Blank parts are skipped. A fold carries the last ``most`` words, so
    what a task holds is the parts of one key."""
    text = F.regexp_replace("text", r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")
    plain = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}_]+", "")
    rows = parts.select(key, "start", "end", "index", F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("words", _words(F.col("text")))
    rows = rows.select(key, "text", F.struct("start", "index", "end", "text", "words", F.transform("words", plain).alias("keys")).alias("part"))
    one = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.when(F.col("text") != "", F.col("part")))).alias("parts"), F.count_if(F.col("text") == "").cast("long").alias("skipped"))

    def step(acc: Column, x: Column) -> Column:
        seconds = F.when(F.size(acc.pieces) > 0, acc.reach - x.start).otherwise(0.0)
        room = F.greatest(F.least(F.lit(most), F.floor(seconds * per_second) + 1), F.lit(2))
        limit = F.when(seconds > 0, F.least(room, F.size(acc.tail), F.size(x["keys"]))).otherwise(0).cast("int")

        def alike(n: Column) -> Column:
            head = F.slice(x["keys"], F.lit(1), n)
            return (F.slice(acc.tail, F.size(acc.tail) - n + 1, n) == head) & ~F.array_contains(head, "")

        def merged(n: Column) -> Column:
            piece = F.when(n == 0, x.text).otherwise(F.array_join(F.slice(x.words, n + 1, F.size(x.words)), " "))
            said = F.concat(acc.tail, F.slice(x["keys"], n + 1, F.size(x["keys"])))
            return F.struct(
                F.when(n < F.size(x.words), F.concat(acc.pieces, F.array(piece))).otherwise(acc.pieces).alias("pieces"),
                F.slice(said, F.greatest(F.size(said) - most, F.lit(0)) + 1, F.lit(most)).alias("tail"),
                x.end.cast("double").alias("reach"),
                (acc.n_overlaps + (seconds > 0).cast("long")).alias("n_overlaps"),
                (acc.dropped + n).alias("dropped"),
            )

        sizes = F.when(limit >= 2, F.sequence(F.lit(2), limit)).otherwise(F.array().cast("array<int>"))
        return bound(F.coalesce(F.array_max(F.filter(sizes, alike)), F.lit(0)), merged)

    start = F.expr(f"CAST(named_struct('pieces', array(), 'tail', array(), 'reach', 0, 'n_overlaps', 0, 'dropped', 0) AS {STITCHED})")
    folded = one.select(key, "skipped", F.aggregate("parts", start, step).alias("all"))
    return folded.select(key, F.array_join("all.pieces", " ").alias("text"), "all.n_overlaps", "all.dropped", "skipped")


#: The bounds of a window and of what needs no windows.
POLICY = {
    "segments": 40, "words": 1200, "input_tokens": 6000, "segment_tokens": 480, "context_tokens": 32768, "schema_tokens": 9000, "overhead_tokens": 2000,
    "target_tokens": 1450, "window_tokens": 1900, "window_segments": 6, "windows": 6, "overlap": 1, "least_tokens": 80, "pause_seconds": 1.2,
}
STOPS = ".!?;,:\n"
NEAR_STOP = 80


def window_decision(segments: DataFrame, key: str, policy: dict[str, float] = POLICY) -> DataFrame:
    """(key, segments, words, input_tokens, reasons): why a transcript needs windows;
    without a reason it is taken whole. Plain sums, combined before the shuffle."""
    tokens = F.coalesce(estimated_tokens("text"), F.lit(0))
    words = F.coalesce(F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0))), F.lit(0))
    sums = segments.groupBy(key).agg(F.count("*").alias("segments"), F.sum(words).alias("words"), (F.sum(tokens) + policy["overhead_tokens"]).alias("input_tokens"), F.max(tokens).alias("_most"))
    reasons = F.array(
        F.when(F.col("segments") > policy["segments"], "segment_count"), F.when(F.col("words") > policy["words"], "normalized_tokens"),
        F.when(F.col("input_tokens") > policy["input_tokens"], "estimated_input_tokens"), F.when(F.col("_most") > policy["segment_tokens"], "oversized_segment"),
        F.when(F.col("input_tokens") > policy["context_tokens"] - policy["schema_tokens"], "provider_context_limit"),
    )
    return sums.select(key, "segments", "words", "input_tokens", F.array_compact(reasons).alias("reasons"))


def cuts(text: str, parts: int) -> list[int]:
    """Where a text falls into about so many parts: behind the stop that is nearest to
    each even length, if one is near, the earlier of two."""
    stops = np.array([m.start() for m in re.finditer(f"[{re.escape(STOPS)}]", text)], np.int64)
    step, at = -(-len(text) // parts), [0]
    while (aim := at[-1] + step) < len(text):
        lo, hi = np.searchsorted(stops, [max(at[-1] + 1, aim - NEAR_STOP), aim + NEAR_STOP])
        near = stops[lo:hi]
        at.append(int(near[np.argmin(np.abs(near - aim))]) + 1 if len(near) else aim)
    return at if at[-1] == len(text) else [*at, len(text)]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _cuts(text: pd.Series, parts: pd.Series) -> pd.Series:
    return pd.Series([cuts(t, int(n)) if n > 1 else [0, len(t)] for t, n in zip(text, parts)])


def split_oversized(segments: DataFrame, key: str, policy: dict[str, float] = POLICY) -> DataFrame:
    """Segments (no, start, end, text) with those of more tokens than a window takes as
    slices at stops, their times by their share of characters; slice counts from 0.
    Null texts are empty."""
    text = segments.withColumn("text", F.coalesce("text", F.lit("")))
    parts = F.least(F.lit(policy["windows"]), F.ceil(F.col("_tokens") / policy["target_tokens"]))
    sized = text.withColumn("_tokens", estimated_tokens("text")).withColumn("_cuts", _cuts("text", F.when(F.col("_tokens") > policy["window_tokens"], parts).otherwise(1).cast("int")))
    spans = F.transform(F.sequence(F.lit(0), F.size("_cuts") - 2), lambda i: F.struct(F.get("_cuts", i).alias("a"), F.get("_cuts", i + 1).alias("b")))
    each = sized.select(key, "no", "start", "end", "text", F.posexplode(spans).alias("slice", "_s"))
    of = lambda edge: F.col("start") + (F.col("end") - F.col("start")) * F.when(F.length("text") > 0, F.col(f"_s.{edge}") / F.length("text")).otherwise(F.lit(1.0 if edge == "b" else 0.0))
    return each.select(key, "no", "slice", of("a").alias("start"), of("b").alias("end"), F.substring("text", F.col("_s.a") + 1, F.col("_s.b") - F.col("_s.a")).alias("text"))


def packed(no: list, start: list, end: list, tokens: list, texts: list, policy: dict[str, float] = POLICY) -> list[list[int]]:
    """Rows of one transcript as windows, lists of row numbers. A window is full by
    tokens, by segments, at a further slice of its last segment, or at a pause; the next
    starts with its last row, but not between slices. Above the most windows, the cheapest
    neighbours become one, rows of one segment and text once."""
    out, lo, held = [], 0, 0
    for i in range(1, len(no) + 1):
        held += tokens[i - 1]
        if i == len(no):
            out.append(list(range(lo, i)))
            break
        slices = no[i] == no[i - 1]
        full = held + tokens[i] > policy["window_tokens"] or i - lo >= policy["window_segments"]
        pause = start[i] - end[i - 1] >= policy["pause_seconds"] and held >= policy["least_tokens"]
        if slices or full or pause:
            out.append(list(range(lo, i)))
            lo = i if slices else max(lo, i - int(policy["overlap"]))
            held = sum(tokens[lo:i])
    # Only the sum of the window that is made anew is taken again.
    sums = np.array([sum(tokens[i] for i in w) for w in out], np.int64)
    while len(out) > policy["windows"]:
        at = int(np.argmin(sums[:-1] + sums[1:]))
        once = {(no[i], texts[i]): i for i in reversed([*out[at], *out[at + 1]])}
        out[at : at + 2] = [sorted(once.values())]
        sums = np.delete(sums, at + 1)
        sums[at] = sum(tokens[i] for i in out[at])
    return out


def planned_windows(segments: DataFrame, key: str, policy: dict[str, float] = POLICY, version: str = "1") -> DataFrame:
    """The windows of each transcript: key, ordinal, window_id, segment numbers in order,
    those that an earlier window has, start, end and tokens. One that needs no windows
    (window_decision) is one. Packing needs a transcript's segments together: a task holds
    one transcript at a time."""
    id_type = segments.schema[key].dataType.simpleString()
    whole = window_decision(segments, key, policy).select(key, (F.size("reasons") == 0).alias("whole"))
    plain = segments.join(whole, key).where("whole").select(key, "no", F.lit(0).alias("slice"), "start", "end", F.coalesce("text", F.lit("")).alias("text"), "whole")
    cut = split_oversized(segments.join(whole.where("NOT whole"), key, "left_semi"), key, policy).withColumn("whole", F.lit(False))
    # Only windows that become one compare texts, so what is whole leaves its text behind.
    rows = plain.unionByName(cut).withColumn("tokens", estimated_tokens("text")).withColumn("text", F.when(~F.col("whole"), F.col("text")))
    names = [key, "no", "slice", "start", "end", "text", "tokens", "whole"]
    dealt = rows.select(*names).repartition(key).sortWithinPartitions(key, "no", "slice")
    nan = float("nan")

    def windows_of(name, group: Iterable[tuple]) -> Iterator[tuple]:
        _, no, _, start, end, texts, tokens, is_whole = map(list, zip(*group, strict=True))
        start, end = ([nan if x is None else x for x in times] for times in (start, end))
        windows = [list(range(len(no)))] if is_whole[0] else packed(no, start, end, tokens, texts, policy)
        seen = set()
        for n, w in enumerate(windows, 1):
            ids = list(dict.fromkeys(no[i] for i in w))
            sign = ",".join(f"{no[i]}:{start[i]:.3f}:{end[i]:.3f}" for i in w)
            digest = hashlib.sha256("\x1f".join([str(name), version, str(n), sign]).encode()).hexdigest()[:24]
            yield (name, n, f"window_{digest}", ids, [i for i in ids if i in seen], min(start[i] for i in w), max(end[i] for i in w), sum(tokens[i] for i in w))
            seen.update(ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Transcripts stream by, one after the other, without a data frame for each."""
        kinds: list[pa.DataType] = []

        def each() -> Iterator[tuple]:
            for batch in batches:
                kinds[:] = [batch.column(key).type, pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64(), pa.float64(), pa.int64()]
                yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)

        found = itertools.chain.from_iterable(windows_of(name, group) for name, group in itertools.groupby(each(), key=lambda row: row[0]))
        while some := list(itertools.islice(found, 2000)):
            columns = [pa.array(c, kind) for c, kind in zip(zip(*some, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "ordinal", "window_id", "segments", "overlap", "start", "end", "tokens"])

    schema = f"key {id_type}, ordinal int, window_id string, segments array<bigint>, overlap array<bigint>, start double, end double, tokens bigint"
    return dealt.mapInArrow(run, schema).withColumnRenamed("key", key)
