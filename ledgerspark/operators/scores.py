"""Scores of predictions and runs against what was expected (inventory A17, A32, A41)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions.lexicon import factual_support
from ledgerspark.functions.text import statements, with_normalized
from ledgerspark.operators.aggregates import prf_of
from ledgerspark.operators.graph import kept


def ratio(a: Column, b: Column) -> Column:
    """a / b; 1 where there is nothing to count."""
    return F.when(b == 0, 1.0).otherwise(a / b)


def coreference_scores(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """One row of accuracies. Both sides: segment_id, anaphor, status, antecedents,
    candidates; predicted also cross_quote and forbidden. A gold link meets the predicted
    one of its segment and anaphor (in any case of letters) if there is exactly one.
    Predictions of a place combine before the shuffle, so none gathers them."""
    place = ["segment_id", F.lower("anaphor").alias("anaphor")]
    sides = [F.array_sort(c).alias(c) for c in ("antecedents", "candidates")]
    p = predicted.select(*place, "status", *sides, "cross_quote", "forbidden")
    g = gold.select(*place, "status", *sides)
    resolved = F.col("status") == "resolved"
    by_place = p.groupBy("segment_id", "anaphor").agg(
        F.count("*").alias("n"), F.min(F.struct("status", "antecedents", "candidates")).alias("link"), F.count_if(resolved).alias("n_resolved"),
        F.count_if(resolved & F.col("cross_quote")).alias("n_cross"), F.count_if(resolved & F.col("forbidden")).alias("n_forbidden"),
    )
    wanted = g.groupBy("segment_id", "anaphor", "status", "antecedents", "candidates").agg(F.count("*").alias("n_gold"))
    met = wanted.join(by_place.where("n = 1").select("segment_id", "anaphor", "link"), ["segment_id", "anaphor"], "left")
    same = F.col("link.status") == F.col("status")
    total = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("n_gold"))), F.lit(0)).alias(name)
    is_ = lambda s: F.col("status") == s
    counts = met.agg(
        total(F.lit(True), "gold_links"), total(same, "correct_status"), total(is_("resolved"), "resolved_gold"), total(is_("ambiguous"), "ambiguous_gold"),
        total(is_("resolved") & (F.col("link.antecedents") == F.col("antecedents")), "correct_antecedents"),
        total(is_("ambiguous") & same & (F.col("link.candidates") == F.col("candidates")), "correct_ambiguous"),
    )
    found = by_place.join(g.select("segment_id", "anaphor").distinct().withColumn("wanted", F.lit(True)), ["segment_id", "anaphor"], "left")
    stray = F.when((F.col("n") == 1) & F.col("wanted"), F.lit(0)).otherwise(F.col("n_resolved"))
    odd = found.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in ((stray, "unsupported_resolved"), (F.col("n_cross"), "cross_quote"), (F.col("n_forbidden"), "forbidden"))])
    return counts.crossJoin(F.broadcast(odd)).select(
        "gold_links", ratio(F.col("correct_status"), F.col("gold_links")).alias("status_accuracy"),
        ratio(F.col("correct_antecedents"), F.col("resolved_gold")).alias("antecedent_accuracy"),
        ratio(F.col("correct_ambiguous"), F.col("ambiguous_gold")).alias("ambiguous_accuracy"), "unsupported_resolved", "cross_quote", "forbidden",
    )


def runtime_budget(results: DataFrame, trace: DataFrame, limits: dict[str, float], key: str = "recording_id") -> DataFrame:
    """Measures of each result that exceed their maximum (failures, in the order of
    ``limits``), and inputs that it lacks (warnings).

    results: key, pipeline_seconds, the four token counts of cleaner and extractor,
    people_count, relationship_count; trace: key, duration_ms."""
    tokens = [f"{who}_{what}" for who in ("cleaner", "extractor") for what in ("prompt_tokens", "completion_tokens")]
    spent = trace.groupBy(key).agg((F.sum(F.coalesce("duration_ms", F.lit(0))) / 1000).alias("total_trace_seconds"))
    n = lambda c: F.when(F.col(c) >= 0, F.col(c)).otherwise(0)
    m = results.join(spent, key, "left").withColumns(
        {
            "total_trace_seconds": F.coalesce("total_trace_seconds", F.lit(0.0)),
            "input_units": n(tokens[0]) + n(tokens[2]), "output_units": n(tokens[1]) + n(tokens[3]),
            "warnings": F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c) < 0), F.lit(c)) for c in tokens], F.when(F.col("pipeline_seconds").isNull(), F.lit("pipeline_seconds")))),
        }
    )
    m = m.withColumn("weighted_cost_units", F.col("input_units") + 4 * F.col("output_units"))
    over = F.array_compact(F.array(*[F.when(F.coalesce(name, F.lit(0)) > most, F.lit(name)) for name, most in limits.items()]))
    return m.select(key, over.alias("failures"), "warnings", "weighted_cost_units").withColumns({"passed": F.size("failures") == 0, "complete": F.size("warnings") == 0})


def statement_support(texts: DataFrame, kind: str = "kind", id_col: str = "id") -> DataFrame:
    """By kind, the sentences of texts (kind, id, text, evidence) and how many their
    own evidence doesn't support, with the share that it does."""
    each = statements(texts.select(F.struct(kind, id_col, "evidence").alias("of"), "text"), "of", "text")
    told = each.select(f"of.{kind}", factual_support("statement", "of.evidence").isin("exact", "ordered").alias("supported"))
    out = told.groupBy(kind).agg(F.count("*").alias("statements"), F.count_if(~F.col("supported")).cast("long").alias("unsupported"))
    return out.withColumn("rate", 1 - F.col("unsupported") / F.col("statements"))


def semantic_match(actual: DataFrame, gold: DataFrame, mentions: DataFrame) -> DataFrame:
    """By case and kind (event, description, story) the matches of found objects and gold
    ones as multisets of keys (label, sorted people, sorted events, sorted segments), and
    for events how many gold ones were found with exactly their people.

    actual: case_id, row (a number of its own), kind, id, label, members (mention ids), events
    (event ids), segments; gold: the same with person and event keys. mentions: case_id,
    mention_id, person_key. A mention without a person, and an event whose key isn't that of
    exactly one gold event, match nothing. A case without objects of a kind has no row.

    People are looked up once and written; only objects that name events are looked up
    again. Both sides meet in one grouping by key."""
    none = F.array().cast("array<string>")

    def based(df: DataFrame) -> DataFrame:
        """df with empty lists for null ones and what its key needs of labels and segments."""
        df = with_normalized(df.withColumns({c: F.coalesce(c, none) for c in ("members", "events", "segments")}), "label")
        return df.withColumn("base", F.to_json(F.struct(F.coalesce("label", F.lit("")).alias("l"), F.sort_array("segments").alias("s"))))

    def told(known: str, sentinel: str) -> Column:
        """What an item is known as; an unknown one keeps a sentinel, so that it equals nothing."""
        return F.sort_array(F.collect_list(F.coalesce(known, F.concat(F.lit(sentinel), "item"))))

    def key(members: Column, events: Column) -> Column:
        return F.concat("base", F.to_json(members), F.when(F.size(events) == 0, "").otherwise(F.to_json(events)))

    people = mentions.where("person_key IS NOT NULL").groupBy("case_id", F.col("mention_id").alias("item")).agg(F.min("person_key").alias("known"))
    each = based(actual).select("case_id", "row", F.struct("kind", "id", "base", "events").alias("x"), F.explode_outer("members").alias("item"))
    found = each.join(people, ["case_id", "item"], "left").groupBy("case_id", "row").agg(F.first("x").alias("x"), told("known", "__unmatched__:").alias("members"))
    found = kept(found.select("case_id", "row", "x.*", "members"))
    want = based(gold).select("case_id", "kind", "id", key(F.sort_array("members"), F.sort_array("events")).alias("key"))

    event, plain = F.col("kind") == "event", F.size("events") == 0
    one = want.where(event).groupBy("case_id", "key").agg(F.count("*").alias("n"), F.min("id").alias("known")).where("n = 1")
    same = found.where(event).select("case_id", F.col("id").alias("item"), key(F.col("members"), F.sort_array("events")).alias("key"))
    same = same.join(one, ["case_id", "key"]).groupBy("case_id", "item").agg(F.min("known").alias("known"))
    named = found.where(~plain).select("case_id", "row", F.struct("kind", "base", "members").alias("x"), F.explode("events").alias("item"))
    named = named.join(same, ["case_id", "item"], "left").groupBy("case_id", "row").agg(F.first("x").alias("x"), told("known", "__unmatched_event__:").alias("events"))
    keys = found.where(plain).select("case_id", "kind", "base", "members", "events").union(named.select("case_id", "x.*", "events"))
    keys = keys.select("case_id", "kind", key(F.col("members"), F.col("events")).alias("key"))

    apart = F.col("case_id").isNull() | F.col("kind").isNull()  # these equal nothing
    sides = [df.select("case_id", "kind", "key", F.when(apart, n).alias("side"), F.lit(1 - n).alias("a"), F.lit(n).alias("e")) for n, df in enumerate((keys, want.drop("id")))]
    met = sides[0].union(sides[1]).groupBy("case_id", "kind", "key", "side").agg(F.sum("a").alias("a"), F.sum("e").alias("e"))
    counts = met.groupBy("case_id", "kind").agg(
        F.sum(F.least("a", "e")).alias("tp"), F.sum(F.greatest(F.col("a") - F.col("e"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("e") - F.col("a"), F.lit(0))).alias("fn"),
        F.sum(F.when(F.col("a") > 0, F.col("e")).otherwise(0)).alias("right"), F.sum("e").alias("of"),
    )
    scored = event & F.col("case_id").isNotNull() & (F.col("of") > 0)
    return counts.select(
        "case_id", "kind", "tp", "fp", "fn", *prf_of(F.col("tp"), F.col("fp"), F.col("fn")),
        F.when(scored, F.col("right")).alias("participants_right"), F.when(scored, F.col("of")).alias("participants_of"),
    )
