"""Windows over state logs and queues, pages and set operations (inventory W8 to
W15, K, U, S8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.operators.aggregates import TERMINAL


def page(df: DataFrame, order: Sequence[Column], limit: int | None = 20, offset: int = 0) -> DataFrame:
    """K1: one page; the limit is held to 1..100 and the offset to 0 or more."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, 20 if limit is None else limit)))


def page_with_total(df: DataFrame, order: Sequence[Column], limit: int | None = 20, offset: int = 0) -> DataFrame:
    """K1: a page whose rows carry the count of all rows; the count is one row, so it is
    broadcast."""
    return page(df, order, limit, offset).crossJoin(F.broadcast(df.agg(F.count("*").alias("total"))))


def newest(df: DataFrame, by: str, order: Sequence[Column], n: int = 5) -> DataFrame:
    """K2: the newest n rows of each group; the window's limit cuts before the shuffle."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("position") <= n)


def claimable_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """K3: queued, due and not leased; or running with a lease run out."""
    free = F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") <= now)
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)
    queued = (F.col("status") == "queued") & due & free
    lost = ~F.col("status").isin(*TERMINAL, "queued") & (F.col("lease_expires_at") <= now)
    return jobs.where(queued | lost)


def latest_state(log: DataFrame, key: str, state: str, order: Sequence[str]) -> DataFrame:
    """The last state of each key and the one before it."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    ranked = log.select(key, F.col(state).alias("current"), F.lead(state).over(w).alias("previous"), F.row_number().over(w).alias("_n"))
    return ranked.where("_n = 1").drop("_n")


def stuck_jobs(jobs: DataFrame, now: Column, pending_hours: int, grace_minutes: int, most: int = 50) -> DataFrame:
    """Jobs pending too long, with a lost lease, or out of attempts; at most
    ``most`` of each reason, oldest first, and each job under its first reason."""
    pending = (F.col("status") == "queued") & (F.col("created_at") < now - F.expr(f"INTERVAL {pending_hours} HOURS"))
    lost = ~F.col("status").isin(*TERMINAL, "queued") & (F.col("lease_expires_at") < now - F.expr(f"INTERVAL {grace_minutes} MINUTES"))
    spent = ~F.col("status").isin(*TERMINAL) & (F.col("attempts") >= F.col("max_attempts"))
    each = None
    for rank, (reason, test, order) in enumerate((("pending_too_long", pending, "created_at"), ("lease_expired", lost, "lease_expires_at"), ("max_retries", spent, "created_at"))):
        part = jobs.where(test).orderBy(order, "job_id").limit(most).select("job_id", F.lit(reason).alias("reason"), F.lit(rank).alias("rank"))
        each = part if each is None else each.unionByName(part)
    return each.groupBy("job_id").agg(F.min_by("reason", "rank").alias("reason"))


def apply_conflict_state(claims: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Resolved: the preferred claim is accepted and the others rejected;
    dismissed: all rejected; open: disputed. Other claims keep their status."""
    each = conflicts.select("conflict_id", "status", "preferred_claim_id", F.explode("claim_ids").alias("claim_id"))
    new = (
        F.when(F.col("status") == "resolved", F.when(F.col("claim_id") == F.col("preferred_claim_id"), "accepted").otherwise("rejected"))
        .when(F.col("status") == "dismissed", "rejected")
        .otherwise("disputed")
    )
    state = each.groupBy("claim_id").agg(F.max_by(new, "conflict_id").alias("_new"))
    return claims.join(state, "claim_id", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def coverage_plan(slots: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Each slot gets a member of every dimension in turn (slot mod size).
    A dimension: a table of (position, value)."""
    out = slots
    for name, dim in dims.items():
        size = dim.agg(F.count("*").alias("_n")).withColumn("_one", F.lit(1))
        out = out.withColumn("_one", F.lit(1)).join(size, "_one").withColumn("position", F.col("slot") % F.col("_n")).drop("_one", "_n")
        out = out.join(dim.select("position", F.col("value").alias(name)), "position").drop("position")
    return out


def manifest_equal(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids only on one side, and ids that repeat on either."""
    x = a.groupBy(key).agg(F.count("*").alias("n_a"))
    y = b.groupBy(key).agg(F.count("*").alias("n_b"))
    j = x.join(y, key, "full").na.fill(0, ["n_a", "n_b"])
    problem = F.when(F.col("n_a") == 0, "unexpected").when(F.col("n_b") == 0, "missing").when((F.col("n_a") > 1) | (F.col("n_b") > 1), "duplicate")
    return j.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def union_typed(tables: dict[str, DataFrame], kind: str = "object_type") -> DataFrame:
    """Rows of several tables under one schema, each with its type; columns that a
    table lacks are null there."""
    out = None
    for name, table in tables.items():
        part = table.withColumn(kind, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def id_difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Ids of one side only, each once, as missing or unexpected."""
    gone = expected.select(key).distinct().join(actual.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    more = actual.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("problem", F.lit("unexpected"))
    return gone.unionByName(more)


def set_relation(a: Column, b: Column) -> Column:
    """How two lists stand as sets: equal, contained (all of a in b), containing,
    overlapping or disjoint. Nulls are empty lists, repeats count once."""
    x, y = (F.array_distinct(F.coalesce(c, F.array())) for c in (a, b))
    common = F.size(F.array_intersect(x, y))
    return (
        F.when((common == F.size(x)) & (common == F.size(y)), "equal").when(common == F.size(x), "contained")
        .when(common == F.size(y), "containing").when(common > 0, "overlapping").otherwise("disjoint")
    )


def idempotent_append(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The batch's rows whose id the target lacks, each id once."""
    return batch.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def merge_unique(a: Column, b: Column) -> Column:
    """U4: ordered union of names; of names that fold alike the first stays."""
    both = F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    return F.aggregate(both, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def first_by(df: DataFrame, key: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The columns of each key's first row in the given order; rows combine before the shuffle."""
    first = F.min_by(F.struct(*cols), F.struct(*order))
    return df.groupBy(key).agg(first.alias("_first")).select(key, "_first.*")


def stuck_cleanup(jobs: DataFrame, now: Column, due_hours: int, grace_minutes: int, most: int = 50) -> DataFrame:
    """The oldest cleanup jobs that wait too long, fail or outlive their lease. Where
    several reasons hold, the last of these three stands."""
    waits = (F.col("status") == "queued") & (F.col("next_attempt_at") < now - F.make_dt_interval(hours=F.lit(due_hours)))
    late = (F.col("status") == "transcribing") & (F.col("lease_expires_at") < now - F.make_dt_interval(mins=F.lit(grace_minutes)))
    reason = F.when(late, "lease_expired").when(F.col("status") == "failed", "failed").when(waits, "overdue")
    return jobs.withColumn("reason", reason).where("reason IS NOT NULL").orderBy("created_at", "job_id").limit(most)


def review_queue(questions: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Open questions with a text, then open conflicts, each newest first: (section,
    id, text, created_at), to be ordered by section, created_at descending and id."""
    part = lambda df, n: df.where("status = 'open' AND trim(text) <> ''").select(F.lit(n).alias("section"), "id", "text", "created_at")
    return part(questions, 0).unionByName(part(conflicts, 1)).orderBy("section", F.desc("created_at"), "id")


def evidence_budget(evidence: DataFrame, by: str, budget: int, order: Sequence[str]) -> DataFrame:
    """All required evidence, and optional evidence in order until each group holds
    the budget. Groups whose required rows alone exceed it are marked."""
    w = Window.partitionBy(by).orderBy(F.desc("required"), *order)
    n = F.sum(F.col("required").cast("int")).over(Window.partitionBy(by))
    ranked = evidence.withColumns({"_n": F.row_number().over(w), "over_budget": n > budget})
    return ranked.where(F.col("required") | (F.col("_n") <= budget)).drop("_n")


def merged_ranges(ranges: DataFrame, key: str, max_len: float = 22.0, max_gap: float = 1.2) -> DataFrame:
    """Neighbouring ranges of a key as one while gaps and the whole length stay within
    the bounds. Gaps alone split a key first, so an array holds one island only; within
    it the cut depends on the running start, which a fold carries."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = F.coalesce((F.col("start") - reach > max_gap).cast("int"), F.lit(1))
    islands = ranges.select(key, "start", "end", cut.alias("_cut")).withColumn("_island", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    arrays = islands.groupBy(key, "_island").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("r"))
    fold = f"""aggregate(r, CAST(array() AS array<struct<start:double,end:double>>), (acc, x) -> CASE
        WHEN size(acc) > 0 AND x.end - element_at(acc, -1).start <= {max_len} AND x.start - element_at(acc, -1).end <= {max_gap}
        THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, CAST(x.end AS double)))))
        ELSE concat(acc, array(named_struct('start', CAST(x.start AS double), 'end', CAST(x.end AS double)))) END)"""
    return arrays.select(key, F.explode(F.expr(fold)).alias("m")).select(key, "m.start", "m.end")
