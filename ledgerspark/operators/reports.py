"""Reports over jobs, archives, corpora and scored extractions. Each is one pass of
partial aggregates, or a few joined on their keys; empty inputs give empty or zero
reports of the same columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of the sensitivity classes. Fixed values.
SENSITIVITY = {"normal": 0, "personal": 1, "sensitive": 2, "highly_sensitive": 3}


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole; one where there is nothing to be right about."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(part / whole)


def book_queue_health(jobs: DataFrame, now: Column, terminal: tuple[str, ...] = ("completed", "failed", "cancelled")) -> DataFrame:
    """Jobs queued, running, failed and completed, seconds that the oldest queued one
    has waited (null if none), and leases of unfinished jobs that ran out."""
    waited = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.min(F.when(F.col("status") == "queued", F.col("created_at").cast("timestamp"))))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("queued", "running", "failed", "completed")]
    ran_out = F.count_if(~F.col("status").isin(*terminal) & (F.col("lease_expires_at") <= now)).alias("expired_leases")
    return jobs.agg(*counts, F.round(waited / 1e6, 2).alias("oldest_queued_seconds"), ran_out)


def overview(families: DataFrame, parts: dict[str, DataFrame], stories: DataFrame, recent: int = 5) -> DataFrame:
    """One row a family: the rows of each part, of stories, what waits for review
    (open conflicts and open questions), and the newest stories' ids.

    parts: people, relationships, recordings, open_conflicts and open_questions, each
    with family_id; stories: family_id, story_id, created_at. Parts are counted
    before they are joined, so no family's rows meet in one task."""
    counted = None
    names = [*parts, "stories"]
    for name, df in {**parts, "stories": stories}.items():
        one = df.groupBy("family_id").agg(F.count("*").alias("n")).select("family_id", F.lit(name).alias("part"), "n")
        counted = one if counted is None else counted.unionByName(one)
    wide = counted.groupBy("family_id").agg(*[F.sum(F.when(F.col("part") == n, F.col("n"))).alias(n) for n in names])
    order = Window.partitionBy("family_id").orderBy(F.desc("created_at"), "story_id")
    newest = stories.select("family_id", "story_id", F.row_number().over(order).alias("at")).where(F.col("at") <= recent)
    newest = newest.groupBy("family_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "story_id"))), lambda s: s.story_id).alias("recent_stories"))
    all_of = families.select("family_id").distinct().join(wide, "family_id", "left").join(newest, "family_id", "left")
    found = {n: F.coalesce(n, F.lit(0)).cast("long") for n in names}
    out = all_of.select("family_id", *[c.alias(n) for n, c in found.items()], "recent_stories")
    return out.withColumn("review", F.col("open_conflicts") + F.col("open_questions"))


def corpus_registry(samples: DataFrame, id_col: str, texts: dict[str, str], lists: dict[str, str]) -> DataFrame:
    """One row a sample: words of each text and entries of each list (null: none)."""
    from ledgerspark.functions.evidence import word_count

    counts = [F.coalesce(word_count(c), F.lit(0)).alias(n) for n, c in texts.items()]
    return samples.select(id_col, *counts, *[F.coalesce(F.size(c), F.lit(0)).cast("long").alias(n) for n, c in lists.items()])


def corpus_totals(registry: DataFrame, sums: list[str], mean: str) -> DataFrame:
    """Samples, sums of columns and the mean of one."""
    return registry.agg(F.count("*").alias("samples"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.avg(mean).alias(f"mean_{mean}"))


def plan_coverage(slots: DataFrame, by: str, anchor: str) -> DataFrame:
    """Slots and distinct anchors of each value, a null value among them."""
    return slots.groupBy(by).agg(F.count("*").alias("slots"), F.count_distinct(anchor).alias("anchors"))


def year_facet(df: DataFrame, years: Column) -> DataFrame:
    """Distinct years of an array column over all rows, newest first."""
    return df.select(F.explode(years).alias("year")).distinct().orderBy(F.desc("year"))


def book_progress(chapters: DataFrame, done: str = "approved") -> DataFrame:
    """One row a book: chapters, those done, words, number of the first chapter that
    isn't done, and the continuity note of the latest chapter that has one (of several
    of one number, the greatest)."""
    return chapters.groupBy("book_id").agg(
        F.count("*").alias("chapters"),
        F.count_if(F.col("status") == done).alias("approved"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
        F.min(F.when(~F.col("status").eqNullSafe(F.lit(done)), F.col("number"))).alias("next_chapter"),
        F.max(F.when(F.col("continuity").isNotNull(), F.struct("number", "continuity")))["continuity"].alias("continuity"),
    )


def acceptance_report(objects: DataFrame, issues: DataFrame, candidates: DataFrame) -> DataFrame:
    """Accepted objects, distinct objects with an error or a fatal issue, and how many
    of the relationship candidates were accepted (null where there were none).

    objects: object_type, object_id; issues: object_type, object_id, severity;
    candidates: one row each."""
    accepted = objects.agg(F.count("*").alias("accepted"), F.count_distinct(F.when(F.col("object_type") == "relationship", F.col("object_id"))).alias("relationships"))
    bad = issues.where(F.col("severity").isin("error", "fatal") & F.col("object_id").isNotNull())
    # A null type is a type of its own here; count_distinct would leave it out.
    refused = bad.select("object_type", "object_id").distinct().agg(F.count("*").alias("quarantined"))
    asked = candidates.agg(F.count("*").alias("candidates"))
    rate = F.when(F.col("candidates") > 0, F.col("relationships") / F.col("candidates")).alias("acceptance_rate")
    return accepted.crossJoin(refused).crossJoin(asked).select("accepted", "quarantined", "candidates", "relationships", rate)  # one row each


def evidence_classes(objects: DataFrame) -> DataFrame:
    return objects.groupBy("evidence_class").agg(F.count("*").alias("n"))


def direction_accuracy(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Of the predicted relations whose type and unordered pair occur in the gold
    ones, the share that has the gold direction: relationship_type, subject, object."""
    pair = [F.col("relationship_type"), F.least("subject", "object").alias("_a"), F.greatest("subject", "object").alias("_b")]
    told = gold.select("relationship_type", "subject", "object").distinct()
    known = told.select(*pair).distinct()
    asked = pred.select("relationship_type", "subject", "object", *pair[1:]).join(known, ["relationship_type", "_a", "_b"], "left_semi")
    right = asked.join(told.withColumn("_right", F.lit(True)), ["relationship_type", "subject", "object"], "left")
    sums = right.agg(F.count_if("_right").alias("right"), F.count("*").alias("asked"))
    return sums.withColumn("accuracy", _ratio(F.col("right"), F.col("asked")))


def label_accuracy(pred: DataFrame, gold: DataFrame, key: str, label: str) -> DataFrame:
    """Share of the gold keys whose predicted label is theirs. Keys are unique on
    either side; two null labels agree."""
    both = gold.select(key, F.col(label).alias("_gold")).join(pred.select(key, F.col(label).alias("_pred"), F.lit(True).alias("_there")), key, "left")
    sums = both.agg(F.count_if(F.col("_there").isNotNull() & F.col("_pred").eqNullSafe(F.col("_gold"))).alias("right"), F.count("*").alias("asked"))
    return sums.withColumn("accuracy", _ratio(F.col("right"), F.col("asked")))


def scope_overlap(pred: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Intersection over union of two sets of keys; one if both are empty."""
    sides = pred.select(key, F.lit(1).alias("side")).unionByName(gold.select(key, F.lit(2).alias("side")))
    sums = sides.groupBy(key).agg(F.count_distinct("side").alias("n")).agg(F.count_if(F.col("n") == 2).alias("common"), F.count("*").alias("either"))
    return sums.withColumn("overlap", _ratio(F.col("common"), F.col("either")))


def sensitivity_recall(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """Gold items above normal (``asked``), those met by a match of at least their
    class, and those whose matches are all of a lower one. Items without a match are
    neither. pred, gold: keys and sensitivity."""
    rank = F.coalesce(*[F.when(F.col("sensitivity") == name, F.lit(r)) for name, r in SENSITIVITY.items()])
    best = pred.withColumn("_rank", rank).groupBy(*keys).agg(F.max("_rank").alias("_best"))
    asked = gold.withColumn("_rank", rank).where("_rank > 0").join(best, keys, "left")
    sums = asked.agg(F.count("*").alias("asked"), F.count_if(F.col("_best") >= F.col("_rank")).alias("met"), F.count_if(F.col("_best") < F.col("_rank")).alias("underclassified"))
    return sums.withColumn("recall", _ratio(F.col("met"), F.col("asked")))


def padded_ranges(df: DataFrame, sample_rate: int, total: Column, padding_seconds: float = 0.45, most_seconds: float = 24.9) -> DataFrame:
    """Ranges start_sample to end_sample grown on both sides within the recording's
    ``total`` samples. What is longer than the most is trimmed on both sides, the
    smaller half on the left."""
    pad, most = int(padding_seconds * sample_rate), int(most_seconds * sample_rate)
    start, end = F.greatest(F.lit(0), F.col("start_sample") - pad), F.least(total, F.col("end_sample") + pad)
    grown = df.withColumns({"start_sample": start.cast("long"), "end_sample": end.cast("long")})
    length = F.col("end_sample") - F.col("start_sample")
    over = F.when(length / sample_rate > most_seconds, length - most).otherwise(F.lit(0))
    left = F.floor(over / 2)
    return grown.withColumns({"start_sample": F.col("start_sample") + left, "end_sample": F.col("end_sample") - (over - left)})


def reopened_conflicts(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Conflicts after a new look at the claims, and what was done with each.

    current: key, claim_ids (sorted) that disagree now; previous: key, claim_ids,
    status, preferred_claim_id. A changed set, or a resolved conflict whose preferred
    claim is no longer in it, is opened again without preference (auto_reopen); a new
    key is opened (insert); all else stays (keep), conflicts that no claims disagree
    on any more included."""
    now = current.select("key", F.array_sort("claim_ids").alias("_now"))
    both = now.join(previous, "key", "full")
    changed = ~F.col("_now").eqNullSafe(F.array_sort("claim_ids"))
    gone = (F.col("status") == "resolved") & ~F.coalesce(F.array_contains("_now", F.col("preferred_claim_id")), F.lit(False))
    action = F.when(F.col("_now").isNull(), "keep").when(F.col("status").isNull(), "insert").when(changed | gone, "auto_reopen").otherwise("keep")
    held = both.withColumn("action", action)
    kept = F.col("action") == "keep"
    return held.select(
        "key", F.coalesce("_now", "claim_ids").alias("claim_ids"), F.when(kept, F.col("status")).otherwise("open").alias("status"),
        F.when(kept, F.col("preferred_claim_id")).alias("preferred_claim_id"), "action",
    )
