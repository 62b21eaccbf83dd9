"""State that a stream folds by key: current states, leases, reservations, and tables
that grow without repeats. As in windows.py, a static DataFrame gives the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerspark.operators.ordering import idempotent_append


def latest(log: DataFrame, key: str, state: str, order: Sequence[str]) -> DataFrame:
    """Each key's current state and when it came, as the row that is last in
    ``order`` (its first column the time) tells; the state kept is one row a key. Of a
    stream, write it in update or complete mode. Rows without a key are left out."""
    last = F.max_by(F.struct(F.col(state).alias("state"), F.col(order[0]).alias("since")), F.struct(*order))
    return log.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("_last"), F.count("*").alias("n_changes")).select(key, "_last.state", "_last.since", "n_changes")


def queue_depth(states: DataFrame, pending: Sequence[str] = ("queued",)) -> DataFrame:
    """How many keys wait, and since when the oldest does."""
    waits = F.col("state").isin(*pending)
    return states.agg(F.count_if(waits).cast("long").alias("depth"), F.min(F.when(waits, F.col("since"))).alias("oldest"))


def lease_expiry(events: DataFrame, key: str, lease: str, terminal: Sequence[str], order: Sequence[str], now: Column | None = None, late: str = "1 hour") -> DataFrame:
    """(key, expired_at) for each lease (its length with its grace) that ran out
    before it was renewed, unless the last event before that was terminal.

    Events that renew each other in time are one session, whose end is the expiry; a
    stream gives it in append mode once the watermark passes, a static table up to ``now``."""
    marked = events.withWatermark("created_at", late) if events.isStreaming else events
    # The window's own end is a key: a condition on it would be pushed below the merge.
    end = F.max("created_at") + F.expr(f"INTERVAL {lease}")
    one = marked.groupBy(key, F.session_window("created_at", lease)).agg(F.max_by("status", F.struct(*order)).alias("last"), end.alias("expired_at"))
    lost = one.where(F.col("last").isNull() | ~F.col("last").isin(*terminal)).select(key, "expired_at")
    return lost if now is None else lost.where(F.col("expired_at") <= now)


def reservation_expiry(log: DataFrame, ttl: str, late: str = "1 hour") -> DataFrame:
    """(reservation_id, reserved_at, outcome) of a log of reserved, committed and
    released rows. The first end before the time to live is over stays; without one the
    reservation is expired, and what comes later changes nothing.

    A reserved row opens a session as long as its time to live; ends are points in it,
    so sessions of ends alone are late and fall out."""
    marked = log.withWatermark("created_at", late) if log.isStreaming else log
    reserved, at = F.col("status") == "reserved", F.col("created_at")
    gap = F.when(reserved, F.lit(ttl)).otherwise(F.lit("1 microsecond"))
    one = marked.groupBy("reservation_id", F.session_window("created_at", gap)).agg(
        F.min(F.when(reserved, at)).alias("reserved_at"),
        F.min(F.when(F.col("status").isin("committed", "released"), F.struct(at, "status"))).alias("ended"),
    )
    in_time = F.col("ended.created_at") < F.col("reserved_at") + F.expr(f"INTERVAL {ttl}")
    outcome = F.when(in_time, F.col("ended.status")).otherwise("expired")
    return one.where("reserved_at IS NOT NULL").select("reservation_id", "reserved_at", outcome.alias("outcome"))


def ingest(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's rows whose id the Parquet table at ``path`` lacks,
    each id once. A batch that runs again after a failure finds its own ids there."""
    schema = stream.schema

    def append(batch: DataFrame, _: int) -> None:
        target = batch.sparkSession.read.schema(schema).option("ignoreMissingFiles", "true").parquet(path)
        idempotent_append(target, batch, key).write.mode("append").parquet(path)

    stream.sparkSession.createDataFrame([], schema).write.mode("append").parquet(path)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
