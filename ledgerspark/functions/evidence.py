"""Texts and the evidence quoted from them: words with offsets, years, verbatim
quotes, offsets of spans, terms and digests of rows. A null text gives null."""

from __future__ import annotations

import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.functions.text import WORD, _col, words

#: Least and greatest year of each dialect: whole corpora, and family snapshots.
YEARS = {"corpus": (1700, 2099), "snapshot": (1800, 2099)}


#: Code points of the texts whose offsets one step of Python may hold.
OFFSETS_STEP = 4_000_000


def word_offsets(docs: DataFrame, text_col: str = "text", out: str = "words", step: int | None = None) -> DataFrame:
    """docs with array ``out`` of the start and end (code points, end exclusive) of each
    word. Offsets have no built-in: Arrow batches pass through Python, which holds two
    numbers a word, and gives back rows by the ``step`` code points (one text at least)."""
    found_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    at, most = docs.columns.index(text_col), step or OFFSETS_STEP

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        word = regex.compile(WORD)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, "right")))
                part = batch.slice(lo, hi - lo)
                edges, ends, null = array("q"), [0], []
                for text in part.column(at):
                    for m in word.finditer(text.as_py() or ""):
                        edges.extend(m.span())
                    ends.append(len(edges) // 2)
                    null.append(not text.is_valid)
                pairs = np.array(edges, np.int64).reshape(-1, 2)
                values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["start", "end"])
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(null))
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*part.schema.names, out])
                lo = hi

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, found_type)]))


#: Characters that are composed already and that nothing before them composes with.
COMPOSED = r"\x00-\u02FF\u0400-\u0482\u048A-\u052F\u2010-\u2027\u2116"


@F.pandas_udf(T.StringType())
def _composed_beyond(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore") if text.notna().any() else text


def _composed(text: Column) -> Column:
    """NFC. Only texts with characters that it may change are held by Python."""
    beyond = text.rlike(f"[^{COMPOSED}]")
    return F.when(beyond, _composed_beyond(F.when(beyond, text))).otherwise(text)


def spaced(text: Column | str) -> Column:
    """Composed characters (NFC), and runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(_composed(_col(text)), r"(?U)\s+", " "))


def word_count(text: Column | str) -> Column:
    """Runs of characters other than white space."""
    return F.size(F.regexp_extract_all(_col(text), F.lit(r"(?U)\S+"), F.lit(0))).cast("long")


def years(text: Column | str, dialect: str = "corpus") -> Column:
    """The years that stand as words of their own, in order, repeats included."""
    least, most = YEARS[dialect]
    numbers = F.transform(F.filter(words(text), lambda w: w.rlike("^[0-9]{4}$")), lambda w: w.cast("int"))
    return F.filter(numbers, lambda y: y.between(least, most))


def verbatim_quotes(docs: DataFrame, id_col: str, text_col: str, quotes: DataFrame, quote_col: str) -> DataFrame:
    """Each quote with its verdict: verbatim, empty, or absent from its text. White
    space and composition of characters don't count. A quote of an unknown text is
    absent."""
    texts = docs.select(id_col, spaced(text_col).alias("_text"))
    held = quotes.withColumn("_quote", F.coalesce(spaced(quote_col), F.lit(""))).join(texts, id_col, "left")
    found = F.coalesce(F.col("_text").contains(F.col("_quote")), F.lit(False))
    return held.withColumn("verdict", F.when(F.col("_quote") == "", "empty").when(found, "verbatim").otherwise("absent")).drop("_quote", "_text")


def recovered_offsets(spans: DataFrame, segments: DataFrame) -> DataFrame:
    """Spans with the offsets their exact text has in the declared layer of their own
    segment, and how that was found.

    spans: evidence_id, segment_id, source_layer, text, start_char, end_char (code
    points from 0, end exclusive; a null layer is the raw one). segments: segment_id,
    raw_text, readable_text (null if there is none). Nothing is searched outside the
    segment, and of several occurrences none is chosen: ``found`` is already_valid,
    recovered, ambiguous (offsets become null), missing, wrong_source_layer,
    unknown_segment, invalid_text or unrecoverable (unknown layer)."""
    layer = F.coalesce("source_layer", F.lit("raw_transcript"))
    raw = layer == "raw_transcript"
    known = segments.select("segment_id", F.col("raw_text").alias("_raw"), F.col("readable_text").alias("_readable"), F.lit(True).alias("_known"))
    held = spans.join(known, "segment_id", "left").withColumns({"_in": F.when(raw, F.col("_raw")).otherwise(F.col("_readable")), "_other": F.when(raw, F.col("_readable")).otherwise(F.col("_raw"))})
    here = F.expr("substring(_in, start_char + 1, end_char - start_char)") == F.col("text")
    fits = (F.col("start_char") >= 0) & (F.col("end_char") - F.col("start_char") == F.length("text")) & here
    held = held.withColumn("_first", F.expr("locate(text, _in)")).withColumn("_second", F.expr("CASE WHEN _first > 0 THEN locate(text, _in, _first + 1) ELSE 0 END"))
    found = (
        F.when(F.col("_known").isNull(), "unknown_segment")
        .when(F.coalesce(F.col("text"), F.lit("")) == "", "invalid_text")
        .when(~layer.isin("raw_transcript", "readable_transcript"), "unrecoverable")
        .when(F.col("_in").isNull(), "wrong_source_layer")
        .when(F.coalesce(fits, F.lit(False)), "already_valid")
        .when(F.col("_second") > 0, "ambiguous")
        .when(F.col("_first") > 0, "recovered")
        .when(F.coalesce(F.expr("locate(text, _other)") > 0, F.lit(False)), "wrong_source_layer")
        .otherwise("missing")
    )
    held = held.withColumn("found", found)
    start = F.when(F.col("found") == "recovered", F.col("_first") - 1).when(F.col("found") != "ambiguous", F.col("start_char"))
    end = F.when(F.col("found") == "recovered", F.col("_first") - 1 + F.length("text")).when(F.col("found") != "ambiguous", F.col("end_char"))
    return held.withColumns({"start_char": start, "end_char": end}).select(*spans.columns, "found")


def terms_in(text: Column | str, terms: list[str]) -> Column:
    """The given terms that the lower-case text holds between characters other than
    letters and digits, in order of the alphabet."""
    low, edge = F.lower(_col(text)), r"[\p{L}\p{N}]"
    kept = [F.when(low.rlike(rf"(?<!{edge})\Q{t}\E(?!{edge})"), t) for t in sorted({t.strip().lower() for t in terms} - {""})]
    return F.when(low.isNotNull(), F.array_compact(F.array(*kept)))


def canonical_digest(columns: list[str], volatile: tuple[str, ...] = ()) -> Column:
    """SHA-256 of a row's compact JSON with its keys in order, nulls included and
    volatile columns left out."""
    kept = [F.col(c) for c in sorted(set(columns) - set(volatile))]
    return F.sha2(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}), 256)
