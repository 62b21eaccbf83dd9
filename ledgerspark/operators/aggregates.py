"""Aggregations (inventory A): one pass with conditional counts, combined before the
shuffle; ratios are made from sums at the end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.operators.predicates import seconds_between

TERMINAL = ("completed", "failed")


def count_if(c: Column) -> Column:
    return F.count_if(c).cast("long")


def queue_health(jobs: DataFrame, now: Column) -> DataFrame:
    """A1: counts by state, age of the oldest queued job, expired leases."""
    s = F.col("status")
    running = ~s.isin(*TERMINAL, "queued")
    return jobs.agg(
        count_if(s == "queued").alias("queued"), count_if(running).alias("running"),
        *[count_if(s == t).alias(t) for t in TERMINAL],
        F.max(F.when(s == "queued", seconds_between(now, F.col("created_at")))).alias("oldest_queued_seconds"),
        count_if(running & (F.col("lease_expires_at") <= now)).alias("expired_leases"),
    )


def throughput(jobs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """A2: jobs that completed or failed in the trailing window."""
    recent = F.col("completed_at") >= now - F.expr(f"INTERVAL {hours} HOURS")
    return jobs.where(recent).agg(*[count_if(F.col("status") == t).alias(t) for t in TERMINAL])


def cleanup_health(jobs: DataFrame, now: Column) -> DataFrame:
    """A4: due against waiting, running, failed, and out of attempts."""
    queued = F.col("status") == "queued"
    due = F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)
    return jobs.agg(
        count_if(queued & due).alias("due"), count_if(queued & ~due).alias("waiting"),
        count_if(~F.col("status").isin(*TERMINAL, "queued")).alias("running"), count_if(F.col("status") == "failed").alias("failed"),
        count_if(F.col("attempts") >= F.col("max_attempts")).alias("exhausted"),
    )


def usage_window(events: DataFrame, reservations: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """A5: usage and cost of the trailing window. Consumed is the larger of what is
    committed and what telemetry saw, plus active reservations. Three one-row
    aggregates meet in one row."""
    since = now - F.expr(f"INTERVAL {hours} HOURS")
    e = events.where(F.col("created_at") >= since).agg(
        F.count("*").alias("n_events"), count_if(F.col("success")).alias("n_success"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")],
        F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(24,6)").alias("telemetry_cost"),
    )
    state = F.col("status")
    r = reservations.where(F.col("created_at") >= since).agg(
        F.coalesce(F.sum(F.when(state == "committed", F.coalesce("actual_cost", "reserved_cost"))), F.lit(0)).cast("decimal(24,6)").alias("committed_cost"),
        F.coalesce(F.sum(F.when((state == "reserved") & (F.col("expires_at") > now), F.col("reserved_cost"))), F.lit(0)).cast("decimal(24,6)").alias("active_cost"),
    )
    both = e.withColumn("_one", F.lit(1)).join(r.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn("consumed_cost", F.greatest("committed_cost", "telemetry_cost") + F.col("active_cost"))


def budget_available(usage: DataFrame, extra: Column, budget: Column) -> DataFrame:
    """Whether an extra cost still fits, the budget included."""
    return usage.withColumn("available", F.col("consumed_cost") + extra <= budget)


def quota_usage(recordings: DataFrame, now: Column, by: str) -> DataFrame:
    """Rows, bytes and audio of each family (or user), all and in 24 hours."""
    recent = F.col("created_at") >= now - F.expr("INTERVAL 24 HOURS")
    return recordings.groupBy(by).agg(
        count_if(F.col("active")).alias("active_jobs"), count_if(recent).alias("recordings_24h"), F.sum("size_bytes").alias("stored_bytes"),
        F.coalesce(F.sum(F.when(recent, F.col("duration_seconds"))), F.lit(0)).alias("audio_24h"),
    )


def quota_decision(requests: DataFrame, family: DataFrame, user: DataFrame, limits: dict) -> DataFrame:
    """The first limit that each request would break, against stored history
    (not against other requests of the batch). Counts break at the limit, amounts
    beyond it."""
    f = family.select("family_id", *[F.col(c).alias(f"f_{c}") for c in family.columns if c != "family_id"])
    u = user.select("user_id", *[F.col(c).alias(f"u_{c}") for c in user.columns if c != "user_id"])
    j = requests.join(f, "family_id", "left").join(u, "user_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    d, size = F.col("duration_seconds"), F.col("size_bytes")
    decision = (
        F.when(d > limits["max_audio"], "audio_too_long")
        .when(n("f_active_jobs") >= limits["active"], "family_active")
        .when(n("f_recordings_24h") >= limits["family_day"], "family_daily")
        .when(n("u_recordings_24h") >= limits["user_day"], "user_daily")
        .when(n("f_stored_bytes") + size > limits["storage"], "family_storage")
        .when(n("u_audio_24h") + d > limits["user_audio"], "user_audio")
        .when(n("f_audio_24h") + d > limits["family_audio"], "family_audio")
        .otherwise("allowed")
    )
    return j.select(*requests.columns, decision.alias("decision"))


def stage_durations(trace: DataFrame) -> DataFrame:
    """A10: per job the duration of each stage, the total, and its attempts."""
    stage = trace.groupBy("job_id", "stage").agg(F.sum("duration_ms").alias("ms"), F.collect_set("attempt").alias("a"))
    return stage.groupBy("job_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("stage", F.coalesce("ms", F.lit(0)))))).alias("stages"),
        F.coalesce(F.sum("ms"), F.lit(0)).alias("total_ms"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("a")))).alias("attempts"),
    )


def latency_profile(samples: DataFrame, by: str | None, value: str) -> DataFrame:
    """Exact percentiles (interpolated), least, most and mean. Without ``by`` it is one
    row of all samples rounded to two places, of zeros where there are none."""
    if by is None:
        one = latency_profile(samples.withColumn("_all", F.lit(1)), "_all", value).drop("_all")
        rows = one.unionByName(samples.sparkSession.range(1).select(F.lit(0).cast("long").alias("n")), allowMissingColumns=True)
        return rows.agg(F.max("n").alias("n"), *[F.round(F.coalesce(F.max(c).cast("double"), F.lit(0.0)), 2).alias(c) for c in rows.columns if c != "n"])
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)]))
    out = samples.groupBy(by).agg(F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select(by, "n", "min", *[F.get("q", F.lit(i)).alias(p) for i, p in enumerate(("p50", "p90", "p95", "p99"))], "max", "mean")


def ratio(a: Column, b: Column, empty: float = 1.0) -> Column:
    return F.when(b == 0, F.lit(empty)).otherwise(a / b)


def prf_of(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1")]


def multiset_prf(actual: DataFrame, expected: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Matches are the smaller count of each key; 0/0 is 1."""
    cols = [*by, *keys]
    a = actual.groupBy(*cols).agg(F.count("*").alias("n_actual"))
    e = expected.groupBy(*cols).agg(F.count("*").alias("n_expected"))
    j = a.join(e, cols, "full").na.fill(0, ["n_actual", "n_expected"])
    sums = j.groupBy(*by).agg(
        F.coalesce(F.sum(F.least("n_actual", "n_expected")), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.greatest(F.col("n_actual") - F.col("n_expected"), F.lit(0))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.greatest(F.col("n_expected") - F.col("n_actual"), F.lit(0))), F.lit(0)).alias("fn"),
    )
    return sums.select(*by, "tp", "fp", "fn", *prf_of(F.col("tp"), F.col("fp"), F.col("fn")))


def set_prf(actual: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same on distinct keys."""
    return multiset_prf(actual.select(*keys).distinct(), expected.select(*keys).distinct(), keys)


def micro_average(cases: DataFrame) -> DataFrame:
    """Counts are summed over cases, then divided."""
    s = cases.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])
    return s.select("tp", "fp", "fn", *prf_of(F.col("tp"), F.col("fp"), F.col("fn")))


def attribute_conflicts(claims: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Keys with more than one distinct value, and the values."""
    return claims.where(F.col(value).isNotNull()).groupBy(*by).agg(F.sort_array(F.collect_set(value)).alias("values")).where(F.size("values") > 1)


def relationship_conflicts(claims: DataFrame) -> DataFrame:
    """Unordered pairs of people with more than one distinct signature."""
    a, b = F.col("subject_person_id"), F.col("object_person_id")
    symmetric = F.col("relationship_type").isin("spouse", "sibling")
    signature = F.concat_ws("|", "relationship_type", F.when(symmetric, F.least(a, b)).otherwise(a).cast("string"), F.when(symmetric, F.greatest(a, b)).otherwise(b).cast("string"))
    pairs = claims.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("person_a"), F.greatest(a, b).alias("person_b"), signature.alias("s"))
    return pairs.groupBy("person_a", "person_b").agg(F.count_distinct("s").alias("n_signatures")).where("n_signatures > 1")


def graph_edges(claims: DataFrame) -> DataFrame:
    """One edge per canonical relationship, with its sorted sources."""
    cols = ["relationship_type", "subject_person_id", "object_person_id"]
    return claims.groupBy(*cols).agg(F.sort_array(F.collect_set("claim_id")).alias("source_claim_ids"))


def person_profiles(claims: DataFrame, people: DataFrame) -> DataFrame:
    """Per person and predicate the earliest value; people with none stay."""
    first = claims.groupBy("person_id", "predicate").agg(F.min_by("value", F.struct("created_at", "claim_id")).alias("value"), F.count("*").alias("n"))
    facets = first.groupBy("person_id").agg(
        F.sort_array(F.collect_list(F.struct("predicate", "value"))).alias("facets"), F.sum("n").alias("n_claims")
    )
    return people.join(facets, "person_id", "left").withColumn("n_claims", F.coalesce("n_claims", F.lit(0)))


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.groupBy(*keys).agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("duplicates"))


def histogram(df: DataFrame, code: str) -> DataFrame:
    """Rows of each code."""
    return df.groupBy(code).agg(F.count("*").alias("n"))


def gate_report(measured: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Each threshold (metric, rule min or max, bound) against its measurement;
    a missing measurement fails."""
    j = thresholds.join(measured, "metric", "left")
    good = F.when(F.col("rule") == "min", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return j.select("metric", "rule", "bound", "value", F.coalesce(good, F.lit(False)).alias("passed"))


def weakest_class(objects: DataFrame, evidence: DataFrame) -> DataFrame:
    """The weakest class (A is strongest, U weakest) over an object's known evidence
    and its own class, ``fallback_class``. Unknown evidence doesn't count."""
    rank = lambda c: F.when(F.col(c) == "U", "Z").otherwise(F.col(c))
    each = objects.select("object_id", F.explode("evidence_ids").alias("evidence_id")).join(evidence, "evidence_id")
    worst = each.groupBy("object_id").agg(F.max(rank("evidence_class")).alias("_worst"))
    both = objects.select("object_id", rank("fallback_class").alias("_own")).join(worst, "object_id", "left").select("object_id", F.greatest("_own", "_worst").alias("_rank"))
    return both.select("object_id", F.when(F.col("_rank") == "Z", "U").otherwise(F.col("_rank")).alias("evidence_class"))


def first_duplicate_wins(df: DataFrame, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows any of whose labels an earlier row has."""
    seen = F.lit(False)
    for c in cols:
        w = Window.partitionBy(c).orderBy(*order)
        seen = seen | (F.col(c).isNotNull() & (F.row_number().over(w) > 1))
    return df.withColumn("repeated", seen)


def book_quota_decision(requests: DataFrame, usage: DataFrame, by: str, most_a_day: int = 3) -> DataFrame:
    """conflict where one is active, then the daily limit, then the budget (column
    ``affordable`` of the request), else accepted."""
    known = requests.join(usage.select(by, "active_jobs", "recordings_24h"), by, "left")
    decision = (
        F.when(F.coalesce("active_jobs", F.lit(0)) >= 1, "conflict")
        .when(F.coalesce("recordings_24h", F.lit(0)) >= most_a_day, "daily_limit")
        .when(~F.coalesce("affordable", F.lit(False)), "budget_exhausted")
        .otherwise("accepted")
    )
    return known.select(*[F.col(c) for c in requests.columns], decision.alias("decision"))


def resolution_scores(predicted: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """One row: accuracy of the status over all gold rows and of the identity over
    those resolved in gold; false merges (another person, or one where gold has
    none) and false splits (none where gold has one). No gold rows score 1."""
    p = predicted.select(key, F.col("status").alias("_ps"), F.col("person_id").alias("_pp"))
    j = gold.join(p, key, "left")
    resolved = F.col("person_id").isNotNull()
    same = F.col("_pp").eqNullSafe(F.col("person_id"))
    n = j.agg(
        F.count("*").alias("n"),
        count_if(F.col("_ps").eqNullSafe(F.col("status"))).alias("status_right"),
        count_if(resolved).alias("n_resolved"),
        count_if(resolved & same).alias("identity_right"),
        count_if(F.col("_pp").isNotNull() & ~same).alias("false_merges"),
        count_if(resolved & F.col("_pp").isNull()).alias("false_splits"),
    )
    return n.select(
        "n", ratio(F.col("status_right"), F.col("n")).alias("status_accuracy"), ratio(F.col("identity_right"), F.col("n_resolved")).alias("identity_accuracy"), "false_merges", "false_splits"
    )


def event_date_conflicts(events: DataFrame, by: Sequence[str], date: Sequence[str]) -> DataFrame:
    """Birth and death events of the same participants, in any order, that give more
    than one date."""
    keyed = events.where(F.col("event_type").isin("birth", "death")).withColumn("participants", F.sort_array("participants"))
    n = keyed.groupBy(*by, "event_type", "participants").agg(F.count("*").alias("n_events"), F.count_distinct(F.struct(*date)).alias("n_dates"))
    return n.where("n_events >= 2 AND n_dates > 1")


def people_summary(people: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per person: distinct stories and recordings, and the earliest relation that isn't blank."""
    n = mentions.groupBy("person_id").agg(
        F.count_distinct("story_id").alias("n_stories"),
        F.count_distinct("recording_id").alias("n_recordings"),
        F.min_by("relation", F.when(F.trim("relation") != "", F.struct("created_at", "claim_id"))).alias("relation"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return people.select("person_id").join(n, "person_id", "left").select("person_id", zero("n_stories"), zero("n_recordings"), "relation")


def entity_counts(entities: dict[str, DataFrame], by: str) -> DataFrame:
    """Rows of each entity in each group; each table is counted before the union."""
    parts = [df.groupBy(by).agg(F.count("*").alias("n")).select(by, F.lit(name).alias("entity"), "n") for name, df in entities.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def error_rates(pairs: DataFrame, counts: str, by: Sequence[str] = ()) -> DataFrame:
    """Errors of edit counts (a struct of text.edit_counts) and their rate by the
    reference's units, at least one; overall, or for each group."""
    part = lambda n: F.coalesce(F.sum(F.col(f"{counts}.{n}")), F.lit(0))
    kinds = ("substitutions", "deletions", "insertions")
    sums = pairs.groupBy(*by).agg(F.count("*").alias("n_pairs"), part("n_reference").alias("n_reference"), *[part(k).alias(k) for k in kinds])
    errors = sum((F.col(k) for k in kinds), F.lit(0))
    return sums.withColumn("errors", errors).withColumn("rate", F.col("errors") / F.greatest(F.col("n_reference"), F.lit(1)))
