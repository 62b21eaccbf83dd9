"""Where queries of the library are registered, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.plans.views import NOW, NOW_EVENTS, VIEWS, view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def now():
    return F.expr(NOW)


def now_events():
    return F.expr(NOW_EVENTS)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df's rows dealt by their keys over all cores, three tasks a core at least. A file of
    few row groups is read by as few tasks, which then do all work on its rows."""
    spark = df.sparkSession
    return df.repartition(max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def query(name: str, tables: str, run: Callable[..., DataFrame], sql: str | None = None) -> None:
    """Registers a query over tables; ``sql`` may name them."""
    names = tables.split()
    QUERIES[name] = lambda spark, sf_dir: run(*[view(spark, sf_dir, t) for t in names])
    if sql:
        SQL[name] = with_views(sql, *[t for t in dict.fromkeys(names) if t in VIEWS])
