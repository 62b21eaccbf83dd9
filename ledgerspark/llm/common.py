"""What the operators of this subpackage share: scratch tables in the shared
folder, and a way to add one struct column computed from a text column."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a batch that Python turns into objects at once.
SLICE_ROWS = 256


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only a local master,
    whose driver and executors are one process, may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="ledgerspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back, so that
    no later job computes them again and a lost executor costs a reread only."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, name: str) -> DataFrame:
    """df without a column of this name (in any case of letters)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()])


def give_back() -> None:
    """Returns to the system what a task held: a worker lives on, and an executor has several
    of them beside its heap, idle ones too."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which gives its memory back when a task is done."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return task


def with_text_struct(
    df: DataFrame, text_col: str, out: str, fields: T.StructType, make: Callable[[], Callable[[str | None], tuple]]
) -> DataFrame:
    """df with a struct column ``out`` computed from the whole of ``text_col``.

    ``make()`` runs once in each task and returns the function for one text.
    Like withColumn, it replaces an existing column named ``out``; every other
    column passes unchanged and every row stays."""
    base = without(df, out)
    schema = T.StructType([*base.schema.fields, T.StructField(out, fields, False)])
    at = [c.lower() for c in base.columns].index(text_col.lower())
    names, kinds = schema.fieldNames(), list(to_arrow_schema(fields))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                rows = [work(x) for x in part.column(at).to_pylist()]
                values = [pa.array(v, type=k.type) for v, k in zip(zip(*rows), kinds, strict=True)]
                struct = pa.StructArray.from_arrays(values, fields=kinds)
                yield pa.RecordBatch.from_arrays([*part.columns, struct], names=names)

    return base.mapInArrow(lean(run), schema)


def small_rows(df: DataFrame, bound: int) -> list | None:
    """The rows of df if there are at most ``bound``, else None."""
    rows = df.limit(bound + 1).collect()
    return rows if len(rows) <= bound else None


def with_struct(
    df: DataFrame, inputs: list[str], out: str, fields: T.StructType, make: Callable[[], Callable[..., tuple]]
) -> DataFrame:
    """with_text_struct for functions of several columns: ``make()`` returns the function
    of their values in one row."""
    base = without(df, out)
    schema = T.StructType([*base.schema.fields, T.StructField(out, fields, False)])
    lower = [c.lower() for c in base.columns]
    at = [lower.index(c.lower()) for c in inputs]
    names, kinds = schema.fieldNames(), list(to_arrow_schema(fields))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                rows = [work(*x) for x in zip(*(part.column(i).to_pylist() for i in at), strict=True)]
                values = [pa.array(v, type=k.type) for v, k in zip(zip(*rows), kinds, strict=True)]
                struct = pa.StructArray.from_arrays(values, fields=kinds)
                yield pa.RecordBatch.from_arrays([*part.columns, struct], names=names)

    return base.mapInArrow(lean(run), schema)
