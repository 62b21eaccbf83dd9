"""Structured streams over event time. Each function takes a streaming DataFrame
(a static one gives the same rows at once) and returns one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.operators.predicates import seconds_between


def usage_rolling(events: DataFrame, hours: int = 24, slide_hours: int = 1, late: str = "1 hour") -> DataFrame:
    """Sums of tokens and cost over windows of a day that slide by an hour; a window
    ends once the watermark passes it."""
    w = F.window("created_at", f"{hours} hours", f"{slide_hours} hours")
    sums = events.withWatermark("created_at", late).groupBy(w).agg(F.count("*").alias("n_events"), F.sum("input_tokens").alias("input_tokens"), F.sum("cost").alias("cost"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_events", "input_tokens", "cost")


def trace_deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """One event per trace, attempt and sequence; state is dropped behind the watermark."""
    keys = ["trace_id", "attempt", "sequence"]
    marked = events.withWatermark("created_at", late)
    return marked.dropDuplicatesWithinWatermark(keys) if events.isStreaming else marked.dropDuplicates(keys)


def stage_pairs(events: DataFrame, late: str = "1 hour", longest: str = "1 hour") -> DataFrame:
    """Start and finish of each (trace, stage) joined within a time bound, which lets
    the state of unmatched rows go: (trace_id, stage, started_at, duration_ms)."""
    side = lambda phase, at: events.where(F.col("phase") == phase).select("trace_id", "stage", F.col("created_at").alias(at)).withWatermark(at, late)
    s, f = side("start", "started_at").alias("s"), side("finish", "finished_at").alias("f")
    bound = F.expr(f"s.trace_id = f.trace_id AND s.stage = f.stage AND finished_at >= started_at AND finished_at <= started_at + INTERVAL {longest}")
    ms = F.floor(seconds_between(F.col("finished_at"), F.col("started_at")) * 1000)
    return s.join(f, bound).select("s.trace_id", "s.stage", "started_at", ms.alias("duration_ms"))


def speech_sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events whose gaps stay within the bound: (key, start, end of
    the last event's reach, events)."""
    n = events.withWatermark("created_at", late).groupBy(key, F.session_window("created_at", gap)).agg(F.count("*").alias("n_events"))
    return n.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")
