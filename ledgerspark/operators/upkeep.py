"""Upkeep of an archive: what may be deleted, what must be, what a restore lacks, and
one row on its state (inventory E9, E10, E11, E13)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators.aggregates import TERMINAL, cleanup_health, queue_health, throughput
from ledgerspark.operators.ordering import stuck_jobs, union_typed


def expired_traces(trace: DataFrame, jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Trace rows older than the cutoff whose jobs also ended before it."""
    ended = jobs.where(F.col("status").isin(*TERMINAL) & (F.col("completed_at") < cutoff)).select("job_id").distinct()
    return trace.where(F.col("created_at") < cutoff).join(ended, "job_id", "left_semi")


def erasure_set(tables: Mapping[str, tuple[DataFrame, str, str]], roots: DataFrame, key: str) -> DataFrame:
    """(kind, id) of all rows that belong to the roots, each once. tables: kind to
    (rows, id column, column that names the root)."""
    gone = roots.select(F.col(key).alias("_root")).distinct()
    parts = {kind: rows.select(F.col(id_).cast("string").alias("id"), F.col(of).alias("_root")).join(gone, "_root", "left_semi").select("id").distinct() for kind, (rows, id_, of) in tables.items()}
    return union_typed(parts, "kind")


def object_deletions(objects: DataFrame) -> DataFrame:
    """Each stored object once, by kind, backend and key; rows without a key name none."""
    return objects.where(F.trim("storage_key") != "").select("kind", "backend", "storage_key").distinct()


def restore_counts(tables: Mapping[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """Tables whose rows a manifest (name, n_rows) counts otherwise, or doesn't know,
    or that are missing (n_found null). Each table is one count."""
    found = None
    for name, rows in tables.items():
        one = rows.agg(F.count("*").alias("n_found")).select(F.lit(name).alias("name"), "n_found")
        found = one if found is None else found.unionByName(one)
    both = manifest.select("name", "n_rows").join(found, "name", "full")
    return both.where(~F.col("n_rows").eqNullSafe(F.col("n_found")))


def monitoring_summary(jobs: DataFrame, cleanup: DataFrame, now: Column, pending_hours: int, grace_minutes: int) -> DataFrame:
    """One row: the queue, what ended lately, clean-up and stuck jobs. One-row
    aggregates meet in one row."""
    prefixed = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    stuck = stuck_jobs(jobs, now, pending_hours, grace_minutes).agg(F.count("*").alias("jobs"))
    parts = [prefixed(queue_health(jobs, now), "queue"), prefixed(throughput(jobs, now), "day"), prefixed(cleanup_health(cleanup, now), "cleanup"), prefixed(stuck, "stuck")]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))
    return out
