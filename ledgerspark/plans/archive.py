"""Queries of people, remarks, transcripts, scores, upkeep and streamed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import claims as K
from ledgerspark.functions import lexicon as X
from ledgerspark.functions.text import bound
from ledgerspark.operators import graph as G
from ledgerspark.operators import joins as J
from ledgerspark.operators import people as H
from ledgerspark.operators import predicates as P
from ledgerspark.operators import scores as C
from ledgerspark.operators import support as V
from ledgerspark.operators import transcripts as W
from ledgerspark.operators import upkeep as U
from ledgerspark.operators.ingest import ingest_claims
from ledgerspark.plans.register import now, now_events, query, spread
from ledgerspark.plans.views import NOW, NOW_EVENTS, split_columns
from ledgerspark.streaming import state as S

def empty() -> Column:
    return F.array().cast("array<string>")


def listed(c: str) -> Column:
    return F.when(F.col(c) != "", F.array(c)).otherwise(empty())


# People.
def archive_people(p: DataFrame) -> DataFrame:
    maps = F.when(F.col("person_id") % 7 > 0, F.create_map(F.lit("1"), F.col("relation"))).otherwise(F.create_map().cast("map<string,string>"))
    return p.select("family_id", "person_id", "canonical_name", F.array("alias").alias("aliases"), F.array("verified").alias("verified_aliases"), "category", maps.alias("relations"), F.array(F.lit("0")).alias("recording_ids"))


def archive_mentions(m: DataFrame) -> DataFrame:
    verified = F.when(F.col("mention_id") % 4 == 0, listed("alias")).otherwise(empty())
    return m.withColumns({"verified_aliases": verified, "aliases": listed("alias"), "variants": F.array("variant")})


def flat_people(p: DataFrame) -> DataFrame:
    pairs = F.transform(F.map_entries("relations"), lambda e: F.concat_ws("=", e.key, e.value))
    return p.select("person_id", "canonical_name", "category", *[F.array_join(c, ",").alias(c) for c in ("aliases", "verified_aliases")], F.size("recording_ids").cast("long").alias("n_recordings"), F.array_join(F.array_sort(pairs), ",").alias("relations"))


_FOLD = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_KEY = r"regexp_replace(lower({}), '[^a-z0-9_]+', '', 'g')"


def _names(rows: str) -> str:
    """SQL: names of (person_id, late, o1, o2, name) rows, each key once, joined in order."""
    key = _FOLD.format("name")
    return f"""SELECT person_id, string_agg(name, ',' ORDER BY late, o1, o2) AS names FROM (SELECT *, row_number() OVER (PARTITION BY person_id, {key} ORDER BY late, o1, o2) AS n FROM ({rows}) WHERE {key} <> '') WHERE n = 1 GROUP BY 1"""


query("S9_upsert_people", "known_people surfaces", lambda p, m: flat_people(H.upsert_people(archive_people(p), archive_mentions(m))), f""", m AS (SELECT * FROM surfaces WHERE person_id IS NOT NULL),
base AS (SELECT person_id, coalesce(k.canonical_name, f.name) AS canonical_name, coalesce(CASE WHEN k.category <> 'unknown' THEN k.category END, f.category, 'unknown') AS category FROM known_people k
  FULL JOIN (SELECT person_id, arg_min(name, position) AS name, arg_min(category, position) FILTER (category <> 'unknown') AS category FROM m GROUP BY 1) f USING (person_id)),
al AS ({_names("SELECT person_id, 0 AS late, 0 AS o1, 0 AS o2, alias AS name FROM known_people UNION ALL SELECT person_id, 1, position, 0, name FROM m JOIN base USING (person_id) WHERE " + _FOLD.format("name") + " <> " + _FOLD.format("canonical_name") + " UNION ALL SELECT person_id, 1, position, 1, alias FROM m")}),
ve AS ({_names("SELECT person_id, 0 AS late, 0 AS o1, 0 AS o2, verified AS name FROM known_people UNION ALL SELECT person_id, 1, position, 0, alias FROM m WHERE mention_id % 4 = 0")}),
rc AS (SELECT person_id, count(DISTINCT r) AS n FROM (SELECT person_id, '0' AS r FROM known_people UNION ALL SELECT person_id, recording_id FROM m) GROUP BY 1),
rl AS (SELECT person_id, string_agg(s || '=' || r, ',' ORDER BY s || '=' || r) AS relations FROM (SELECT person_id, s, arg_max(r, p) AS r FROM (SELECT person_id, '1' AS s, relation AS r, -1 AS p FROM known_people WHERE person_id % 7 > 0 UNION ALL SELECT person_id, speaker_id::VARCHAR, relation, position FROM m WHERE relation IS NOT NULL) GROUP BY 1, 2) GROUP BY 1)
SELECT person_id, canonical_name, category, coalesce(al.names, '') AS aliases, coalesce(ve.names, '') AS verified_aliases, n AS n_recordings, coalesce(rl.relations, '') AS relations FROM base LEFT JOIN al USING (person_id) LEFT JOIN ve USING (person_id) LEFT JOIN rc USING (person_id) LEFT JOIN rl USING (person_id)""")
query("J10_mention_candidates", "surfaces known_people", lambda m, p: H.mention_candidates(archive_mentions(m), archive_people(p)), f""", s AS (SELECT family_id, mention_id, w, {_KEY.format("x")} AS n FROM (SELECT family_id, mention_id, 'name' AS w, name AS x FROM surfaces UNION ALL SELECT family_id, mention_id, 'alias', alias FROM surfaces UNION ALL SELECT family_id, mention_id, 'variant', variant FROM surfaces)),
k AS (SELECT family_id, person_id, {_KEY.format("canonical_name")} AS c, {_KEY.format("verified")} AS v, {_KEY.format("alias")} AS a FROM known_people)
SELECT DISTINCT mention_id, person_id, rule FROM (SELECT mention_id, person_id, 'name_canonical' AS rule FROM s JOIN k ON s.family_id = k.family_id AND n = c AND w = 'name' UNION ALL SELECT mention_id, person_id, 'name_alias' FROM s JOIN k ON s.family_id = k.family_id AND n = a AND w = 'name'
UNION ALL SELECT mention_id, person_id, 'name_verified' FROM s JOIN k ON s.family_id = k.family_id AND n = v AND w = 'name' UNION ALL SELECT mention_id, person_id, 'mention_alias' FROM s JOIN k ON s.family_id = k.family_id AND n IN (c, a) AND w = 'alias'
UNION ALL SELECT mention_id, person_id, CASE n WHEN c THEN 'variant_canonical' WHEN v THEN 'variant_verified' ELSE 'variant_alias' END FROM s JOIN k ON s.family_id = k.family_id AND n IN (c, v, a) AND w = 'variant')""")
_KIND = "CASE event_type WHEN 'view' THEN ' Birth' WHEN 'click' THEN 'смерть' WHEN 'purchase' THEN 'Work' WHEN 'error' THEN 'мектеп' ELSE event_type END"
_FACETS = [f"event_id, {_KIND} AS event_type", "'title ' || event_type AS title, CASE WHEN event_id % 3 > 0 THEN 'about ' || CAST(user_id AS STRING) WHEN event_id % 2 = 0 THEN '' END AS description", "CASE WHEN user_id % 4 > 0 THEN 'place ' || CAST(user_id % 4 AS STRING) ELSE '' END AS location, CASE WHEN user_id % 5 > 0 THEN CAST(1900 + user_id % 90 AS STRING) END AS date_value"]
query("A23_event_facets", "events", lambda e: H.event_facets(e.selectExpr(*split_columns(", ".join(_FACETS)), "array(user_id, user_id + 1) AS participants")), f"""WITH e AS (SELECT {", ".join(_FACETS)}, unnest([user_id, user_id + 1]) AS mention_id FROM events),
f AS (SELECT *, lower(trim(event_type)) AS k, coalesce(nullif(description, ''), title) AS what FROM e)
SELECT event_id, mention_id, 'event' AS attribute, what AS value FROM f UNION ALL SELECT event_id, mention_id, 'location', location FROM f WHERE location <> '' UNION ALL SELECT event_id, mention_id, 'birth_date', date_value FROM f WHERE k = 'birth' AND date_value IS NOT NULL
UNION ALL SELECT event_id, mention_id, 'death_date', date_value FROM f WHERE k = 'смерть' AND date_value IS NOT NULL UNION ALL SELECT event_id, mention_id, 'profession', what FROM f WHERE k = 'work' UNION ALL SELECT event_id, mention_id, 'education', what FROM f WHERE k = 'мектеп'""")

# Texts. The SQL finds markers by its own boundaries, as its patterns know no letters beyond ASCII.
_PLAIN = r"' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) || ' '"


def _bounded(patterns: list[str]) -> str:
    return r"(?i)(^|[^\pL\pM\pN_])(" + "|".join(patterns) + r")([^\pL\pM\pN_]|$)"


def _marked(words: str) -> str:
    return "(" + " OR ".join(f"contains(t, ' {m[:-1]}')" if m.endswith("*") else f"contains(t, ' {m} ')" for m in words.split()) + ")"


def _level(markers: dict[str, str]) -> str:
    return "concat_ws(','" + "".join(f", CASE WHEN {_marked(markers[c])} THEN '{c}' END" for c in sorted(markers)) + ")"


query("T15_sensitivity", "remarks", lambda r: spread(r, "remark_id").select("remark_id", X.sensitivity("text").alias("s")).select("remark_id", "s.level", F.array_join("s.categories", ",").alias("categories")), f"""SELECT remark_id, CASE WHEN h <> '' THEN 'highly_sensitive' WHEN s <> '' THEN 'sensitive' ELSE 'normal' END AS level, CASE WHEN h <> '' THEN h ELSE s END AS categories
FROM (SELECT remark_id, {_level(X.HIGHLY_SENSITIVE)} AS h, {_level(X.SENSITIVE)} AS s FROM (SELECT remark_id, {_PLAIN} AS t FROM remarks))""")
query("T17_relationship_state", "remarks", lambda r: r.select("remark_id", X.relationship_state("text").alias("state")), "SELECT remark_id, CASE WHEN text IS NULL THEN NULL " + " ".join(f"WHEN regexp_matches(text, '{_bounded(p)}') THEN '{s}'" for s, p in X.RELATION_STATES) + " ELSE 'current' END AS state FROM remarks")
query("T22_correction_cues", "remarks", lambda r: r.select("remark_id", F.array_join(X.correction_cues("text"), ",").alias("cues")), "SELECT remark_id, concat_ws(','" + "".join(f", CASE WHEN contains(t, ' {c} ') THEN '{c}' END" for c in X.CORRECTION_CUES) + f", CASE WHEN contains(t, ' {X.CORRECTION_FRAME[0]} ') AND contains(t, ' {X.CORRECTION_FRAME[1]} ') THEN '{' ... '.join(X.CORRECTION_FRAME)}' END) AS cues FROM (SELECT remark_id, {_PLAIN} AS t FROM remarks)")
_LETTERS = ("aeiouymnltkdgs", "аеиоуямнлтқдгс")
_SHORTER = "list_transform(list_filter(ends, lambda e: ends_with({w}, e) AND length({w}) - length(e) >= 3), lambda e: left({w}, length({w}) - length(e)))"
query("T14_inflection_stems", "documents", lambda d: d.select(F.explode(F.regexp_extract_all(F.translate(F.lower("text"), *_LETTERS), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))).alias("word")).distinct().select("word", F.array_join(X.inflection_stems("word"), ",").alias("stems")), rf"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(translate(lower(text), '{_LETTERS[0]}', '{_LETTERS[1]}'), '[\p{{L}}\p{{Nd}}]+')) AS word FROM documents),
o AS (SELECT word, {X.ENDINGS!r} AS ends FROM w), one AS (SELECT word, ends, {_SHORTER.format(w="word")} AS s FROM o)
SELECT word, CASE WHEN length(word) < 3 OR regexp_matches(word, '^\p{{Nd}}+$') THEN word ELSE array_to_string(list_sort(list_distinct(list_concat([word], s, flatten(list_transform(s, lambda v: {_SHORTER.format(w="v")}))))), ',') END AS stems FROM one""")


def remark_evidence(r: DataFrame, e: DataFrame) -> DataFrame:
    """Each recording's remarks against the one that is first by id."""
    first = e.groupBy("recording_id").agg(F.min_by("text", F.when(F.col("text").isNotNull(), F.col("remark_id"))).alias("evidence"))
    return r.join(first, "recording_id", "left")


query("T12_factual_support", "remarks remarks", lambda r, e: remark_evidence(r, e).select("remark_id", X.factual_support("text", "evidence").alias("support")))
query("A41_statement_support_rate", "remarks remarks", lambda r, e: C.statement_support(remark_evidence(r, e).select((F.col("remark_id") % 10).alias("kind"), F.col("remark_id").alias("id"), "text", "evidence")))


# Transcripts.
def overlapping_parts(d: DataFrame) -> DataFrame:
    """Documents as parts of 24 words, of which the next says 4 again; two of three
    boundaries overlap in time."""
    words = F.regexp_extract_all("text", F.lit("[^ \\t\\n\\r]+"), F.lit(0))

    def cut(w):
        many = F.sequence(F.lit(0), F.greatest(F.floor((F.size(w) - 1) / 20), F.lit(0)).cast("int"))
        return F.transform(many, lambda i: F.array_join(F.slice(w, i * 20 + 1, F.lit(24)), " "))

    # All parts of a text are cut at once: beside an exploded column its words would be found anew for each part.
    each = d.select("doc_id", F.posexplode(bound(words, cut)).alias("index", "text"))
    start = F.col("index") * 10.0
    late = F.when(F.col("index") % 3 == 0, 10.0).otherwise(10.75)
    return each.select("doc_id", "index", start.alias("start"), (start + late).alias("end"), "text")


_TAIL = "list_transform({0}, lambda v: regexp_replace(lower(v), '[^\\p{{L}}\\p{{N}}_]+', '', 'g'))"
query("W3_stitch_overlaps", "documents", lambda d: W.stitched(overlapping_parts(spread(d, "doc_id")), "doc_id"), rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r]+') AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, k, w[k * 20 + 1 : k * 20 + 24] AS w, {_TAIL.format("w[k * 20 + 1 : k * 20 + 24]")} AS s, k > 0 AND (k - 1) % 3 <> 0 AS meets FROM (SELECT doc_id, w, unnest(range(0, greatest((len(w) - 1) // 20, 0) + 1)) AS k FROM d)),
r AS (SELECT doc_id, k, array_to_string(w, ' ') AS text, s[-8:] AS tail, 0::BIGINT AS n_overlaps, 0::BIGINT AS dropped FROM p WHERE k = 0 AND len(w) > 0
UNION ALL SELECT doc_id, k, text || CASE WHEN n < len(w) THEN ' ' || array_to_string(w[n + 1 :], ' ') ELSE '' END, list_concat(tail, s[n + 1 :])[-8:], n_overlaps + meets::BIGINT, dropped + n FROM (SELECT *, CASE WHEN meets THEN coalesce(list_max(list_filter(range(2, least(4, len(tail), len(s)) + 1), lambda v: tail[len(tail) - v + 1 :] = s[1 : v] AND NOT list_contains(s[1 : v], ''))), 0) ELSE 0 END AS n
FROM (SELECT r.doc_id, p.k, r.text, r.tail, r.n_overlaps, r.dropped, p.w, p.s, p.meets FROM r JOIN p ON r.doc_id = p.doc_id AND p.k = r.k + 1)))
SELECT doc_id, coalesce(text, '') AS text, coalesce(n_overlaps, 0) AS n_overlaps, coalesce(dropped, 0) AS dropped, CASE WHEN len(w) = 0 THEN 1 ELSE 0 END AS skipped FROM d LEFT JOIN (SELECT doc_id, arg_max(text, k) AS text, arg_max(n_overlaps, k) AS n_overlaps, arg_max(dropped, k) AS dropped FROM r GROUP BY 1) USING (doc_id)""")

# Scores and plans.
_STATUS = "CASE {0} % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'ambiguous' ELSE 'unresolved' END"


def links(c: DataFrame, shift: int) -> DataFrame:
    ids = lambda n: F.array(F.col("subject_person_id") % n, F.col("claim_id") % n)
    return c.select(
        F.col("recording_id").alias("segment_id"), F.concat(F.lit("He" if shift else "he"), (F.col("claim_id") % 10 % 4).cast("string")).alias("anaphor"), F.expr(_STATUS.format(f"(claim_id + CASE WHEN subject_person_id % 4 = 0 THEN {shift} ELSE 0 END)")).alias("status"),
        ids(2 + shift).alias("antecedents"), ids(2).alias("candidates"), (F.col("claim_id") % 7 == 0).alias("cross_quote"), (F.col("claim_id") % 11 == 0).alias("forbidden"),
    )


_LINK = "SELECT recording_id AS s, claim_id % 10 % 4 AS a, {st} AS status, list_sort([subject_person_id % {n}, claim_id % {n}]) AS ante, list_sort([subject_person_id % 2, claim_id % 2]) AS cand, claim_id % 7 = 0 AS cq, claim_id % 11 = 0 AS fb FROM claims"
query("A17_coreference_scores", "claims claims", lambda p, g: C.coreference_scores(links(p.where("claim_id % 10 < 6"), 1), links(g.where("claim_id % 10 < 5"), 0)).select("gold_links", *[F.round(c, 9).alias(c) for c in ("status_accuracy", "antecedent_accuracy", "ambiguous_accuracy")], "unsupported_resolved", "cross_quote", "forbidden"), f""", p AS (SELECT *, count(*) OVER (PARTITION BY s, a) AS n FROM ({_LINK.format(st=_STATUS.format("(claim_id + CASE WHEN subject_person_id % 4 = 0 THEN 1 ELSE 0 END)"), n=3)} WHERE claim_id % 10 < 6)),
g AS ({_LINK.format(st=_STATUS.format("claim_id"), n=2)} WHERE claim_id % 10 < 5), j AS (SELECT g.*, p.status AS ps, p.ante AS pa, p.cand AS pc FROM g LEFT JOIN p ON g.s = p.s AND g.a = p.a AND p.n = 1)
SELECT * FROM (SELECT count(*) AS gold_links, round(count(*) FILTER (ps = status) / count(*), 9) AS status_accuracy, round(count(*) FILTER (status = 'resolved' AND pa = ante) / count(*) FILTER (status = 'resolved'), 9) AS antecedent_accuracy, round(count(*) FILTER (status = 'ambiguous' AND ps = status AND pc = cand) / count(*) FILTER (status = 'ambiguous'), 9) AS ambiguous_accuracy FROM j),
(SELECT count(*) FILTER (NOT (n = 1 AND EXISTS (SELECT 1 FROM g WHERE g.s = p.s AND g.a = p.a))) AS unsupported_resolved, count(*) FILTER (cq) AS cross_quote, count(*) FILTER (fb) AS forbidden FROM p WHERE status = 'resolved')""")
_LIMITS = {"pipeline_seconds": 400, "total_trace_seconds": 3000, "input_units": 110, "output_units": 80, "weighted_cost_units": 400, "people_count": 45, "relationship_count": 8}


def runs(j: DataFrame) -> DataFrame:
    less = lambda c, n: F.when(F.col("job_id") % n > 0, c)
    return j.select(
        F.col("job_id").alias("recording_id"), less(F.col("duration_seconds"), 17).alias("pipeline_seconds"), less(F.col("user_id") % 70, 13).alias("cleaner_prompt_tokens"), (F.col("user_id") % 41).alias("cleaner_completion_tokens"),
        (F.col("user_id") % 60 - 2).alias("extractor_prompt_tokens"), less(F.col("user_id") % 53, 19).alias("extractor_completion_tokens"), (F.col("job_id") % 50).alias("people_count"), (F.col("job_id") % 10).alias("relationship_count"),
    )


query("A32_runtime_budget", "jobs trace", lambda j, t: C.runtime_budget(runs(j), t.select(F.col("job_id").alias("recording_id"), "duration_ms"), _LIMITS).withColumns({c: F.array_join(c, ",") for c in ("failures", "warnings")}), """, m AS (SELECT job_id AS recording_id, CASE WHEN job_id % 17 > 0 THEN duration_seconds END AS ps, CASE WHEN job_id % 13 > 0 THEN user_id % 70 END AS a, user_id % 41 AS b, user_id % 60 - 2 AS c, CASE WHEN job_id % 19 > 0 THEN user_id % 53 END AS d, job_id % 50 AS people, job_id % 10 AS rel, coalesce(t, 0) AS tr
FROM jobs LEFT JOIN (SELECT job_id, sum(duration_ms) / 1000 AS t FROM trace GROUP BY 1) USING (job_id)), n AS (SELECT *, coalesce(a, 0) + greatest(c, 0) AS i, b + coalesce(d, 0) AS o FROM m),
x AS (SELECT recording_id, i + 4 * o AS weighted_cost_units, concat_ws(',', CASE WHEN ps > 400 THEN 'pipeline_seconds' END, CASE WHEN tr > 3000 THEN 'total_trace_seconds' END, CASE WHEN i > 110 THEN 'input_units' END, CASE WHEN o > 80 THEN 'output_units' END, CASE WHEN i + 4 * o > 400 THEN 'weighted_cost_units' END, CASE WHEN people > 45 THEN 'people_count' END, CASE WHEN rel > 8 THEN 'relationship_count' END) AS failures,
concat_ws(',', CASE WHEN a IS NULL THEN 'cleaner_prompt_tokens' END, CASE WHEN c < 0 THEN 'extractor_prompt_tokens' END, CASE WHEN d IS NULL THEN 'extractor_completion_tokens' END, CASE WHEN ps IS NULL THEN 'pipeline_seconds' END) AS warnings FROM n)
SELECT *, failures = '' AS passed, warnings = '' AS complete FROM x""")
query("J13_plan_vs_registry", "part supplier", lambda p, s: J.plan_vs_registry(p.select(F.col("p_partkey").alias("slot_id"), F.col("p_name").alias("anchor"), F.col("p_brand").alias("profession"), F.lit("planned").alias("status")), s.select(F.col("s_suppkey").alias("slot_id"), F.col("s_name").alias("anchor"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name")).otherwise("").alias("profession"))), """SELECT p_partkey AS slot_id, coalesce(s_name, p_name) AS anchor, CASE WHEN s_nationkey % 2 = 0 THEN s_name ELSE p_brand END AS profession, CASE WHEN s_suppkey IS NULL THEN 'planned' ELSE 'done' END AS status FROM part LEFT JOIN supplier ON s_suppkey = p_partkey""")



# Maps of records and traces.
def attributes(e: DataFrame) -> DataFrame:
    """A map of each event under a safe, a sensitive and a plain key."""
    keys = F.array(F.concat(F.lit(" "), F.initcap("event_type"), F.lit("_ID ")), F.lit("Input_Tokens"), F.lit("trace_id"), F.lit("full_name"))
    secret = F.concat(F.lit("use bearer abc"), F.col("event_id").cast("string"), F.lit(".d or eyJh.eyJb.c-1"))
    return e.select("event_id", F.map_from_arrays(keys, F.array(secret, F.col("user_id").cast("string"), F.repeat("event_type", 50), F.lit("x"))).alias("m"))


def told(e: DataFrame) -> DataFrame:
    pairs = F.array_sort(F.transform(F.map_entries("m"), lambda x: F.concat_ws("=", x.key, x.value)))
    return e.select("event_id", F.array_join(pairs, ";").alias("pairs"))


query("P11_redact_map", "events", lambda e: told(P.redact_log_map(attributes(e), "m")), """SELECT event_id, array_to_string(list_sort([' ' || upper(event_type[1]) || event_type[2:] || '_ID =use Bearer [REDACTED] or [REDACTED_TOKEN]', 'Input_Tokens=[REDACTED]', 'trace_id=' || repeat(event_type, 50), 'full_name=x']), ';') AS pairs FROM events""")
query("P12_trace_attributes", "events", lambda e: told(P.trace_attributes(attributes(e), "m", 256, P.TRACE_SENSITIVE, ())), """SELECT event_id, array_to_string(list_sort([event_type || '_id=use bearer abc' || event_id || '.d or eyJh.eyJb.c-1', 'trace_id=' || repeat(event_type, 50)[1:256]]), ';') AS pairs FROM events""")
query("P7_date_view", "claims", lambda c: P.date_view(c.select("claim_id", F.when(F.col("recording_id") % 3 == 0, F.col("value")).alias("normalized_value"), F.col("predicate").alias("value"), F.when(F.col("claim_id") % 4 == 0, F.lit("year")).alias("precision"), F.when(F.col("claim_id") % 5 == 0, F.col("uncertain")).alias("approximate"))).select("claim_id", "date_value", "date_precision", "date_approximate"), "SELECT claim_id, CASE WHEN recording_id % 3 = 0 THEN coalesce(value, predicate) ELSE predicate END AS date_value, CASE WHEN claim_id % 4 = 0 THEN 'year' ELSE 'unknown' END AS date_precision, CASE WHEN claim_id % 5 = 0 THEN coalesce(uncertain, false) ELSE false END AS date_approximate FROM claims")
query("P16_retry_schedule", "events events", lambda e, k: P.retry_schedule(
    e.select("event_id", F.col("event_type").alias("error_code"), (F.col("event_id") % 12 + 1).alias("attempt"), F.when(F.col("user_id") % 4 == 0, F.col("user_id") / 40).alias("retry_after")),
    k.where("event_type <> 'signup'").select(F.col("event_type").alias("error_code")).distinct().select("error_code", F.upper("error_code").alias("category"), F.when(F.col("error_code") == "error", "fail").otherwise("retry").alias("disposition")),
).select("event_id", "category", "disposition", F.round("delay_seconds", 6).alias("delay_seconds")), """SELECT event_id, CASE event_type WHEN 'signup' THEN 'unknown' ELSE upper(event_type) END AS category, d AS disposition, CASE d WHEN 'retry' THEN round(greatest(CASE WHEN user_id % 4 = 0 THEN user_id / 40 ELSE least(2.0 * 2.0 ** (event_id % 12), 300.0) END, 0.5), 6) END AS delay_seconds
FROM (SELECT *, CASE WHEN event_type IN ('signup', 'error') THEN 'fail' ELSE 'retry' END AS d FROM events)""")
query("P17_story_people", "claims people", lambda c, p: P.story_people(c.groupBy(F.col("recording_id").alias("story_id")).agg(F.array_sort(F.collect_set("subject_person_id")).alias("person_ids")), p.where("person_id % 3 <> 0"), 2).select("story_id", F.array_join("shown", ",").alias("shown"), "hidden"), """SELECT recording_id AS story_id, coalesce(string_agg(s::VARCHAR, ',' ORDER BY s) FILTER (k AND n <= 2), '') AS shown, greatest(count(*) FILTER (k) - 2, 0) AS hidden FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, k ORDER BY s) AS n FROM (SELECT DISTINCT recording_id, subject_person_id AS s, subject_person_id % 3 <> 0 AND subject_person_id IN (SELECT person_id FROM people) AS k FROM claims)) GROUP BY 1""")

# Upkeep.
query("E9_expired_traces", "trace jobs", lambda t, j: U.expired_traces(t, j, now_events()).groupBy("stage").agg(F.count("*").alias("n")), f"SELECT stage, count(*) AS n FROM trace WHERE created_at < {NOW_EVENTS} AND job_id IN (SELECT job_id FROM jobs WHERE status IN ('completed', 'failed') AND completed_at < {NOW_EVENTS}) GROUP BY 1")
query("E10_erasure_set", "jobs recordings claims", lambda j, r, c: U.erasure_set({"job": (j, "job_id", "recording_id"), "recording": (r, "recording_id", "recording_id"), "claim": (c, "claim_id", "recording_id")}, j.where("family_id = 7"), "recording_id"), """SELECT DISTINCT kind, id FROM (SELECT 'job' AS kind, job_id::VARCHAR AS id, recording_id FROM jobs UNION ALL SELECT 'recording', recording_id::VARCHAR, recording_id FROM recordings UNION ALL SELECT 'claim', claim_id::VARCHAR, recording_id FROM claims) WHERE recording_id IN (SELECT recording_id FROM jobs WHERE family_id = 7)""")
query("E10_object_deletions", "jobs", lambda j: U.object_deletions(j.select("stage" , F.lit("s3").alias("backend"), F.when(F.col("job_id") % 6 == 0, " ").otherwise(F.concat(F.lit("k/"), (F.col("user_id") % 90).cast("string"))).alias("storage_key")).withColumnRenamed("stage", "kind")), "SELECT DISTINCT stage AS kind, 's3' AS backend, 'k/' || (user_id % 90)::VARCHAR AS storage_key FROM jobs WHERE job_id % 6 <> 0")
query("E11_restore_counts", "jobs claims documents recordings", lambda j, c, d, r: U.restore_counts({"jobs": j, "claims": c, "documents": d}, j.agg(F.count("*").alias("n")).select(F.explode(F.create_map(F.lit("jobs"), F.col("n"), F.lit("claims"), F.col("n"), F.lit("recordings"), F.col("n"))).alias("name", "n_rows"))), "SELECT name, CASE WHEN name <> 'documents' THEN (SELECT count(*) FROM jobs) END AS n_rows, n AS n_found FROM (SELECT 'claims' AS name, count(*) AS n FROM claims UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'recordings', NULL) WHERE name <> 'claims' OR n <> (SELECT count(*) FROM jobs)")
_N = "count(*) FILTER ({}) AS {}"
query("E13_monitoring_summary", "jobs", lambda j: U.monitoring_summary(j, j.where("attempts > 1"), now(), 48, 30), f"""SELECT * FROM (SELECT {_N.format("status = 'queued'", "queue_queued")}, {_N.format("status = 'transcribing'", "queue_running")}, {_N.format("status = 'completed'", "queue_completed")}, {_N.format("status = 'failed'", "queue_failed")},
max(CASE WHEN status = 'queued' THEN (epoch_us({NOW}) - epoch_us(created_at)) / 1e6 END) AS queue_oldest_queued_seconds, {_N.format(f"status = 'transcribing' AND lease_expires_at <= {NOW}", "queue_expired_leases")} FROM jobs),
(SELECT {_N.format("status = 'completed'", "day_completed")}, {_N.format("status = 'failed'", "day_failed")} FROM jobs WHERE completed_at >= {NOW} - INTERVAL 24 HOURS),
(SELECT {_N.format(f"status = 'queued' AND next_attempt_at <= {NOW}", "cleanup_due")}, {_N.format(f"status = 'queued' AND next_attempt_at > {NOW}", "cleanup_waiting")}, {_N.format("status = 'transcribing'", "cleanup_running")}, {_N.format("status = 'failed'", "cleanup_failed")}, {_N.format("attempts >= max_attempts", "cleanup_exhausted")} FROM jobs WHERE attempts > 1),
(SELECT count(DISTINCT job_id) AS stuck_jobs FROM (SELECT * FROM (SELECT job_id FROM jobs WHERE status = 'queued' AND created_at < {NOW} - INTERVAL 48 HOURS ORDER BY created_at, job_id LIMIT 50) UNION ALL SELECT * FROM (SELECT job_id FROM jobs WHERE status = 'transcribing' AND lease_expires_at < {NOW} - INTERVAL 30 MINUTES ORDER BY lease_expires_at, job_id LIMIT 50) UNION ALL SELECT * FROM (SELECT job_id FROM jobs WHERE status IN ('queued', 'transcribing') AND attempts >= max_attempts ORDER BY created_at, job_id LIMIT 50)))""")

# Streamed state.
query("X3_job_state", "decisions", lambda d: S.latest(d, "conflict_id", "resulting_status", ["created_at", "event_id"]).withColumnRenamed("conflict_id", "job_id"), "SELECT conflict_id AS job_id, arg_max(resulting_status, (created_at, event_id)) AS state, max(created_at) AS since, count(*) AS n_changes FROM decisions WHERE conflict_id IS NOT NULL GROUP BY 1")
query("X3_queue_depth", "decisions", lambda d: S.queue_depth(S.latest(d, "conflict_id", "resulting_status", ["created_at", "event_id"]), ["view", "click"]), "SELECT count(*) AS depth, min(since) AS oldest FROM (SELECT arg_max(resulting_status, (created_at, event_id)) AS state, max(created_at) AS since FROM decisions GROUP BY conflict_id) WHERE state IN ('view', 'click')")
query("X7_conflict_log_fold", "decisions", lambda d: S.latest(d, "conflict_id", "resulting_status", ["created_at", "event_id"]).select("conflict_id", "state"), "SELECT conflict_id, arg_max(resulting_status, (created_at, event_id)) AS state FROM decisions GROUP BY 1")
query("X4_lease_expiry", "decisions", lambda d: S.lease_expiry(d.select(F.col("conflict_id").alias("job_id"), F.col("resulting_status").alias("status"), F.col("created_at").cast("timestamp").alias("created_at"), "event_id"), "job_id", "2 days", ["purchase", "error"], ["created_at", "event_id"], now_events().cast("timestamp")).withColumn("expired_at", F.date_format("expired_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")), f"""SELECT job_id, strftime(t + INTERVAL 2 DAYS, '%Y-%m-%d %H:%M:%S.%f') AS expired_at FROM (SELECT conflict_id AS job_id, resulting_status AS s, created_at AS t, lead(created_at) OVER (PARTITION BY conflict_id ORDER BY created_at, event_id) AS nx FROM decisions)
WHERE (nx IS NULL OR nx > t + INTERVAL 2 DAYS) AND s NOT IN ('purchase', 'error') AND t + INTERVAL 2 DAYS <= {NOW_EVENTS}""")


def reservation_log(e: DataFrame) -> DataFrame:
    """Each event reserves; some end early, late, twice or never."""
    at = F.col("ts").cast("timestamp")
    row = lambda kind, status, minutes: e.where(kind).select(F.col("event_id").alias("reservation_id"), F.lit(status).alias("status"), (at + F.expr(f"INTERVAL {minutes} MINUTES")).alias("created_at"))
    early = "event_type IN ('purchase', 'view')"
    return row("TRUE", "reserved", 0).union(row(early, "committed", 30)).union(row("event_type = 'view'", "released", 20)).union(row("event_type = 'click'", "committed", 180))


query("X5_reservation_expiry", "events", lambda e: S.reservation_expiry(reservation_log(e), "2 hours").select("reservation_id", "outcome"), "SELECT event_id AS reservation_id, CASE event_type WHEN 'purchase' THEN 'committed' WHEN 'view' THEN 'released' ELSE 'expired' END AS outcome FROM events")

# Languages, quotes and windows.
_HAS = lambda code: "list_has_any(w, " + repr(X.LANGUAGE_WORDS[code].split()) + ")"
query("T5_read_language", "remarks", lambda r: r.select("remark_id", X.read_language("text").alias("l")).select("remark_id", F.array_join("l.languages", ",").alias("languages"), "l.detected"), rf"""SELECT remark_id, concat_ws(',', CASE WHEN kk THEN 'kk' END, CASE WHEN ru THEN 'ru' END) AS languages, CASE WHEN kk AND ru THEN 'mixed' WHEN kk THEN 'kk' WHEN ru THEN 'ru' ELSE 'unknown' END AS detected
FROM (SELECT remark_id, {_HAS("kk")} OR regexp_matches(t, '[{X.LANGUAGE_LETTERS["kk"]}]') AS kk, {_HAS("ru")} AS ru FROM (SELECT remark_id, t, regexp_extract_all(t, '\p{{L}}+') AS w FROM (SELECT remark_id, lower(coalesce(text, '')) AS t FROM remarks)))""")
query("T23_quotes", "documents", lambda d: d.select("doc_id", F.array_join(F.array_sort(X.quotes(F.translate("text", ".,—–", '"«'))), "|").alias("quotes")), r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(t, '«([^»\n]{5,})»', 1), regexp_extract_all(t, '"([^"\n]{5,})"', 1), regexp_extract_all(t, '“([^”\n]{5,})”', 1), regexp_extract_all(t, '„([^“\n]{5,})“', 1)),
lambda q: trim(regexp_replace(q, '\s+', ' ', 'g'), ' ,;:—–-')), lambda q: length(q) >= 5))), '|') AS quotes FROM (SELECT doc_id, translate(text, '.,—–', '"«') AS t FROM documents)""")


def lines(d: DataFrame) -> DataFrame:
    """Documents as transcripts: a line is a segment of as many seconds as it has
    characters, by ten, and every fourth follows a pause."""
    each = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "text"))
    start = F.col("no") * 10000.0 + F.when(F.col("no") % 4 == 0, 2.0).otherwise(0.0)
    return each.select("doc_id", F.col("no").cast("long").alias("no"), start.alias("start"), (start + 9999.0 - F.when(F.col("no") % 4 == 3, 0.0).otherwise(-1.0)).alias("end"), "text")


_TOKENS = r"greatest(len(regexp_extract_all(t, '[\p{L}\p{M}\p{Nd}\p{Pc}]+')), ceil(length(regexp_replace(t, '\s+', '', 'g')) / 3.5))::BIGINT"
query("W4_window_decision", "documents", lambda d: W.window_decision(lines(d), "doc_id").withColumn("reasons", F.array_join("reasons", ",")), rf"""SELECT doc_id, n AS segments, words::BIGINT AS words, i::BIGINT AS input_tokens, concat_ws(',', CASE WHEN n > 40 THEN 'segment_count' END, CASE WHEN words > 1200 THEN 'normalized_tokens' END, CASE WHEN i > 6000 THEN 'estimated_input_tokens' END, CASE WHEN m > 480 THEN 'oversized_segment' END, CASE WHEN i > 23768 THEN 'provider_context_limit' END) AS reasons
FROM (SELECT doc_id, count(*) AS n, sum(len(regexp_extract_all(t, '[\p{{L}}\p{{N}}_''-]+'))) AS words, sum({_TOKENS}) + 2000 AS i, max({_TOKENS}) AS m FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents) GROUP BY 1)""")
query("W4_plan_windows", "documents", lambda d: W.planned_windows(lines(d), "doc_id").select("doc_id", "ordinal", "window_id", F.array_join("segments", ",").alias("segments"), F.array_join("overlap", ",").alias("overlap"), "tokens"))
query("W5_split_oversized", "documents", lambda d: W.split_oversized(lines(d), "doc_id"))


# Families and components, over a tree of parts.
def tree(p: DataFrame) -> DataFrame:
    child = F.col("p_partkey")
    kin = p.where("p_partkey > 0").select(F.lit("parent_child").alias("relationship_type"), F.floor(child / 3).alias("subject_person_id"), child.alias("object_person_id"))
    wed = p.where("p_size > 40").select(F.lit("spouse"), child, child + 1 + F.col("p_size") % 3)
    return kin.union(wed).union(p.where("p_size < 3").select(F.lit("sibling"), child, child + 5))


def persons(p: DataFrame) -> DataFrame:
    return p.select(F.col("p_partkey").alias("person_id"))


def joined(c: str) -> Column:
    return F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)


query("G2_family_relations", "part part", lambda p, q: G.family_relations(tree(p), persons(q)).select("person_id", joined("parents"), joined("children"), joined("siblings"), "spouse_id"), """WITH k AS (SELECT p_partkey // 3 AS a, p_partkey AS b FROM part WHERE p_partkey > 0), s AS (SELECT p_partkey AS a, p_partkey + 1 + p_size % 3 AS b FROM part WHERE p_size > 40), t AS (SELECT p_partkey AS a, p_partkey + 5 AS b FROM part WHERE p_size < 3),
r AS (SELECT b AS p, 'parents' AS k, a AS o FROM k UNION SELECT a, 'children', b FROM k UNION SELECT x.b, 'siblings', y.b FROM k x JOIN k y ON x.a = y.a AND x.b <> y.b UNION SELECT a, 'siblings', b FROM t UNION SELECT b, 'siblings', a FROM t UNION SELECT a, 'spouse', b FROM s UNION SELECT b, 'spouse', a FROM s)
SELECT p_partkey AS person_id, coalesce(string_agg(o::VARCHAR, ',' ORDER BY o) FILTER (k = 'parents'), '') AS parents, coalesce(string_agg(o::VARCHAR, ',' ORDER BY o) FILTER (k = 'children'), '') AS children, coalesce(string_agg(o::VARCHAR, ',' ORDER BY o) FILTER (k = 'siblings'), '') AS siblings, min(o) FILTER (k = 'spouse') AS spouse_id FROM part LEFT JOIN r ON p = p_partkey GROUP BY 1""")
query("G3_generation_depth", "part part", lambda p, q: G.generation_depth(tree(p).where("relationship_type = 'parent_child'").select(F.col("subject_person_id").alias("parent"), F.col("object_person_id").alias("child")), persons(q)), """WITH RECURSIVE d AS (SELECT 0::BIGINT AS p, 0 AS n UNION ALL SELECT p_partkey, n + 1 FROM d JOIN part ON p_partkey // 3 = p AND p_partkey > 0) SELECT p AS person_id, n AS depth, false AS on_cycle FROM d""")
query("G7_connected_components", "part orders", lambda p, o: G.connected_components(tree(p).where("relationship_type = 'spouse'").select(F.col("subject_person_id").alias("a"), F.col("object_person_id").alias("b")).union(o.select(-F.col("o_custkey") - 1, F.col("o_orderkey") + 1000000000)), people=p.select(F.col("p_partkey").alias("id"))), """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey + 1 + p_size % 3 AS b FROM part WHERE p_size > 40), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS id, a AS c FROM u UNION SELECT u.b, c FROM r JOIN u ON u.a = r.id)
SELECT id, min(c) AS component FROM r GROUP BY 1 UNION ALL SELECT o_orderkey + 1000000000, -o_custkey - 1 FROM orders UNION ALL SELECT DISTINCT -o_custkey - 1, -o_custkey - 1 FROM orders
UNION ALL SELECT p_partkey, p_partkey FROM part WHERE p_partkey NOT IN (SELECT id FROM r)""")


# Ingest: half of the batch is in the archive already. Of rows that share an id the least counts.
_CLAIM = ["subject_person_id", "object_person_id", "relationship_type", "subject_role", "evidence_class", "status", "predicate", "value", "created_at", "recording_id"]


def one_each(c: DataFrame) -> DataFrame:
    return c.groupBy("claim_id").agg(F.min(F.struct(*_CLAIM)).alias("c")).select("claim_id", "c.*", F.col("c.subject_person_id").alias("person_id"))


def ingested(c: DataFrame, p: DataFrame, part: str) -> DataFrame:
    from ledgerspark.plans.registry import judged

    claims = one_each(c)
    return ingest_claims(claims.where("status = 'active'"), claims, judged(claims), p)[part]


_STATES = f""", one AS (SELECT * FROM claims QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY {", ".join(f"{c} NULLS FIRST" for c in _CLAIM)}) = 1),
st AS (SELECT one.*, CASE WHEN p IS NULL THEN status WHEN r % 3 = 1 THEN 'rejected' WHEN r % 3 = 2 THEN 'disputed' WHEN one.claim_id = p THEN 'accepted' ELSE 'rejected' END AS state_now
FROM one LEFT JOIN (SELECT claim_id, recording_id AS r, max(claim_id) OVER (PARTITION BY recording_id) AS p FROM one WHERE relationship_type = 'spouse') USING (claim_id)),
so AS (SELECT * FROM st WHERE state_now IN ('active', 'accepted') AND evidence_class IN ('A', 'B', 'C'))"""
query("E2_ingest_claims", "claims people", lambda c, p: ingested(c, p, "claims").select("claim_id", "status"), _STATES + " SELECT claim_id, state_now AS status FROM st")
query("E2_ingest_edges", "claims people", lambda c, p: ingested(c, p, "edges").select("relationship_type", "subject_person_id", "object_person_id", F.array_join("source_claim_ids", ",").alias("sources")), _STATES + """ SELECT relationship_type, a AS subject_person_id, b AS object_person_id, string_agg(claim_id::VARCHAR, ',' ORDER BY claim_id) AS sources FROM (SELECT claim_id, relationship_type, CASE WHEN relationship_type <> 'parent_child' THEN least(subject_person_id, object_person_id) WHEN subject_role = 'child' THEN object_person_id ELSE subject_person_id END AS a,
CASE WHEN relationship_type <> 'parent_child' THEN greatest(subject_person_id, object_person_id) WHEN subject_role = 'child' THEN subject_person_id ELSE object_person_id END AS b FROM so WHERE subject_person_id <> object_person_id) GROUP BY 1, 2, 3""")

# Dates, clauses and markers of what lines say; the SQL builds what each kind of text must give.
_SAID_DATE = """l_orderkey * 10 + l_linenumber AS remark_id, l_partkey % 12 AS kind, 1900 + l_suppkey % 100 AS y, l_partkey % 12 + 1 AS m, l_suppkey % 31 + 1 AS d, l_linenumber AS n"""
_DATE_TEXT = """CASE kind WHEN 0 THEN CAST(y AS STRING) || '-' || lpad(CAST(m AS STRING), 2, '0') || '-' || lpad(CAST(d AS STRING), 2, '0') WHEN 1 THEN '3/4/' || CAST(y AS STRING) WHEN 2 THEN 'между ' || CAST(y AS STRING) || ' и ' || CAST(1900 + n * 15 AS STRING)
WHEN 3 THEN 'до ' || CAST(y AS STRING) || ' года' WHEN 4 THEN 'после ' || CAST(y AS STRING) WHEN 5 THEN 'примерно ' || CAST(y AS STRING) WHEN 6 THEN ' ' || CAST(y AS STRING) || ' ' WHEN 7 THEN CAST(n AS STRING) || ' мая ' || CAST(y AS STRING) || ' года'
WHEN 8 THEN CAST(d AS STRING) || ' ақпан ' || CAST(y AS STRING) WHEN 9 THEN 'май ' || CAST(y AS STRING) WHEN 10 THEN 'когда ему было ' || CAST(n AS STRING) ELSE '' END"""


def said_dates(lines: DataFrame) -> DataFrame:
    rows = lines.selectExpr(*split_columns(_SAID_DATE)).selectExpr("remark_id", f"{_DATE_TEXT} AS text")
    return rows.select("remark_id", "text", K.parsed_date("text").alias("x")).select("remark_id", "text", "x.*")


query("T18_parsed_dates", "lineitem", said_dates, f"""WITH s AS (SELECT *, {_DATE_TEXT} AS text, y::VARCHAR AS ys, 1900 + n * 15 AS z FROM (SELECT {_SAID_DATE} FROM lineitem)),
c AS (SELECT *, CASE kind WHEN 0 THEN text WHEN 7 THEN ys || '-05-' || lpad(n::VARCHAR, 2, '0') WHEN 8 THEN ys || '-02-' || lpad(d::VARCHAR, 2, '0') END AS day FROM s),
v AS (SELECT *, CASE WHEN day IS NULL THEN kind = 11 OR (kind = 2 AND y > z) ELSE try_cast(day AS DATE) IS NULL END AS bad FROM c)
SELECT remark_id, text, CASE WHEN bad THEN NULL WHEN kind IN (0, 7, 8) THEN 'exact_date' WHEN kind = 1 THEN 'unknown' WHEN kind = 2 THEN 'range' WHEN kind IN (3, 4, 10) THEN 'relative' WHEN kind = 5 THEN 'approximate' WHEN kind = 6 THEN 'year' ELSE 'month_year' END AS kind,
CASE WHEN bad THEN NULL WHEN kind IN (0, 7, 8) THEN 'day' WHEN kind IN (1, 10) THEN 'unknown' WHEN kind = 2 THEN 'range' WHEN kind = 9 THEN 'month' ELSE 'year' END AS "precision",
CASE WHEN bad THEN NULL WHEN day IS NOT NULL THEN day WHEN kind IN (5, 6) THEN ys WHEN kind = 9 THEN ys || '-05' END AS value,
CASE WHEN bad THEN NULL WHEN kind = 2 THEN ys WHEN kind = 4 THEN (y + 1)::VARCHAR WHEN kind = 5 THEN (y - 1)::VARCHAR END AS lower_bound,
CASE WHEN bad THEN NULL WHEN kind = 2 THEN z::VARCHAR || '-12-31' WHEN kind = 3 THEN (y - 1)::VARCHAR || '-12-31' WHEN kind = 5 THEN (y + 1)::VARCHAR || '-12-31' END AS upper_bound,
NOT bad AND kind = 5 AS approximate, CASE WHEN bad THEN NULL WHEN kind = 2 THEN 'between' WHEN kind = 3 THEN 'before' WHEN kind = 4 THEN 'after' WHEN kind = 10 THEN 'at_age' END AS relation,
CASE WHEN bad THEN NULL WHEN kind = 1 THEN 'locale_ambiguous_numeric_date' WHEN kind IN (3, 4) THEN 'semantic_anchor_not_identified' WHEN kind = 10 THEN 'birth_anchor_missing' END AS reason,
CASE WHEN bad THEN CASE WHEN kind = 2 THEN 'temporal_range_invalid' ELSE 'temporal_value_invalid' END WHEN kind = 1 THEN 'temporal_format_ambiguous' WHEN kind IN (3, 4, 10) THEN 'temporal_anchor_missing' END AS issue FROM v""")
_CHECKED = "l_orderkey * 10 + l_linenumber AS remark_id, CASE WHEN l_partkey % 2 = 0 THEN 'около ' ELSE 'в ' END || CAST(1900 + l_suppkey % 90 AS STRING) AS expression, CASE l_linenumber % 3 WHEN 0 THEN 'exact_date' ELSE 'approximate' END AS kind, 'year' AS grain, l_linenumber % 2 = 0 AS approximate, CASE WHEN l_suppkey % 7 = 0 THEN '1950-02-30' ELSE '1950' END AS value, 'Это было  ОКОЛО ' || CAST(1900 + l_suppkey % 90 AS STRING) AS evidence"
query("T19_date_checks", "lineitem", lambda lines: spread(lines.selectExpr(*split_columns(_CHECKED)), "remark_id").select("remark_id", F.array_join(K.date_checks("expression", "kind", "grain", "approximate", "value", "evidence", F.lit(None).cast("string")), ",").alias("issues")), f"""WITH c AS (SELECT {_CHECKED} FROM lineitem)
SELECT remark_id, concat_ws(',', CASE WHEN NOT starts_with(expression, 'около') THEN 'temporal_evidence_unsupported' END, CASE WHEN starts_with(expression, 'около') AND (kind = 'exact_date' OR NOT approximate) THEN 'silently_exactified' END,
CASE WHEN value = '1950-02-30' THEN 'invalid_calendar_value' END, CASE WHEN starts_with(expression, 'около') AND kind = 'exact_date' THEN 'temporal_precision_overstated' END) AS issues FROM c""")
_TOLD = """l_orderkey * 10 + l_linenumber AS remark_id, l_partkey % 5 AS a, l_suppkey % 4 AS b, CASE l_partkey % 5 WHEN 0 THEN 'Асан, кажется, уехал' WHEN 1 THEN 'Асан «наверное» уехал' WHEN 2 THEN 'Асан уехал' WHEN 3 THEN 'есімде жоқ, Асан, вроде, уехал' ELSE 'Асану не кажется' END || '. ' ||
CASE l_suppkey % 4 WHEN 0 THEN 'Дина, шамасы, келді' WHEN 1 THEN 'Дина келді' WHEN 2 THEN 'Дина возможно-то; Асан' ELSE 'без сомнения, возможно' END AS text, CASE WHEN l_linenumber % 2 = 0 THEN 'uncertain' ELSE 'explicit' END AS mode"""


def told_certainty(lines: DataFrame) -> DataFrame:
    rows = spread(lines.selectExpr(*split_columns(_TOLD)), "remark_id").withColumn("names", F.array(F.lit("Дина")))
    rows = K.with_uncertainty(rows, "text", "names", "mode", "u", found=True)
    return rows.select("remark_id", F.size("u_markers").cast("long").alias("n_markers"), F.size("u_clauses").cast("long").alias("n_clauses"), F.col("u.status").alias("status"), F.array_join("u.markers", ",").alias("markers"), F.col("u.issue").alias("issue"))


query("T16_uncertainty", "lineitem", told_certainty, f"""WITH c AS (SELECT *, CASE a WHEN 0 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS na, CASE WHEN b IN (0, 2) THEN 1 ELSE 0 END AS nb, CASE a WHEN 0 THEN 'кажется' WHEN 3 THEN 'есімде жоқ,вроде' END AS ma, CASE b WHEN 0 THEN 'шамасы' WHEN 2 THEN 'возможно' END AS mb, mode = 'uncertain' AS un FROM (SELECT {_TOLD} FROM lineitem))
SELECT remark_id, (na + nb)::BIGINT AS n_markers, CASE WHEN b = 2 THEN 3 ELSE 2 END::BIGINT AS n_clauses,
CASE WHEN b = 3 THEN CASE WHEN un OR na > 0 THEN 'unresolved' END WHEN nb > 0 THEN 'uncertain' WHEN un THEN 'unresolved' END AS status,
CASE WHEN b = 3 THEN CASE WHEN un OR na > 0 THEN coalesce(ma, '') END WHEN nb > 0 THEN mb WHEN un THEN '' END AS markers,
CASE WHEN b = 3 THEN CASE WHEN un OR na > 0 THEN 'uncertainty_scope_ambiguous' END WHEN nb > 0 THEN NULL WHEN un THEN 'uncertainty_marker_unsupported' END AS issue FROM c""")

# What lines of documents are borne out by passages of the benchmark, and which passages they use.
_FLAT = r"trim(regexp_replace(replace(replace(lower({}), 'ß', 'ss'), 'ё', 'е'), '[^\pL\pN-]+', ' ', 'g'))"
_SIG = {name: {side: "(" + " OR ".join(f"contains(p, '{m}')" for m in markers) + ")" for side, markers in two.items()} for name, two in V.SIDES.items()}
_READ = f"""SELECT *, ' ' || flat || ' ' AS p, list_distinct(list_transform(list_filter(string_split(flat, ' '), lambda w: length(w) >= 3 AND w NOT IN ({", ".join(f"'{w}'" for w in V.STOP_WORDS)}) AND NOT regexp_full_match(w, '[0-9]+')), lambda w: left(w, 6))) AS stems"""
_SIGNED = "SELECT *, " + "(" + " OR ".join(f"contains(p, '{m}')" for m in V.NEGATION) + ") AS negated, " + ", ".join(f"CASE WHEN {' AND '.join(two.values())} THEN 'conflicting' " + " ".join(f"WHEN {cond} THEN '{side}'" for side, cond in two.items()) + f" END AS {name}" for name, two in _SIG.items())
_FITS = "s.negated = e.negated AND " + " AND ".join(f"coalesce(s.{n}, '') <> 'conflicting' AND coalesce(e.{n}, '') <> 'conflicting' AND (s.{n} IS NULL OR coalesce(s.{n} = e.{n}, false))" for n in V.SIDES)


def doc_lines(docs: DataFrame) -> DataFrame:
    parts = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    return parts.select(F.lit(0).alias("scope"), (F.col("doc_id") * 100000 + F.col("at")).alias("sentence_id"), "text")


def passages(items: DataFrame) -> DataFrame:
    return items.select(F.lit(0).alias("scope"), F.col("item_id").alias("evidence_id"), "text")


def shops(people: DataFrame) -> DataFrame:
    return people.select(F.lit(0).alias("scope"), F.col("canonical_name").alias("name"))


def planned_passages(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("text_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("evidence_id")).where((F.col("text_id") + F.col("evidence_id")) % 20 == 0)


_PASSAGES = f"e AS ({_SIGNED} FROM ({_READ} FROM (SELECT item_id, text, {_FLAT.format('text')} AS flat FROM benchmark)))"
query("J16_sentence_support", "documents benchmark people", lambda d, b, p: V.sentence_support(doc_lines(spread(d, "doc_id")), passages(b), shops(p)).drop("scope"), f""", l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents),
s AS ({_SIGNED} FROM ({_READ} FROM (SELECT doc_id * 100000 + place AS sentence_id, {_FLAT.format('text')} AS flat FROM l))), {_PASSAGES},
m AS (SELECT sentence_id, min(item_id) AS evidence_id FROM s JOIN e ON {_FITS} AND (contains(e.flat, s.flat) OR contains(s.flat, e.flat) OR len(list_intersect(s.stems, e.stems)) >= 2) WHERE len(s.stems) > 0 AND e.flat <> '' GROUP BY 1)
SELECT sentence_id, len(s.stems) = 0 OR evidence_id IS NOT NULL AS supported, evidence_id FROM s LEFT JOIN m USING (sentence_id)""")
query("J17_evidence_used", "documents benchmark people", lambda d, b, p: V.evidence_used(spread(d, "doc_id").select(F.lit(0).alias("scope"), F.col("doc_id").alias("text_id"), "text"), passages(b), planned_passages(d), shops(p)), f""", {_PASSAGES},
w AS (SELECT doc_id AS text_id, unnest(range(0, 40)) AS evidence_id, text, {_FLAT.format('text')} AS whole FROM documents), k AS (SELECT * FROM w WHERE (text_id + evidence_id) % 20 = 0),
s AS ({_SIGNED} FROM ({_READ} FROM (SELECT doc_id AS text_id, {_FLAT.format('text')} AS flat FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?…\\n]+')) AS text FROM documents)))),
u AS (SELECT DISTINCT k.text_id, k.evidence_id FROM k JOIN e ON e.item_id = k.evidence_id JOIN s ON s.text_id = k.text_id WHERE {_FITS} AND len(e.stems) >= 2 AND len(list_intersect(s.stems, e.stems)) >= greatest(2, least(4, greatest(2, len(e.stems) // 3))))
SELECT k.text_id, k.evidence_id, u.text_id IS NOT NULL OR coalesce(e.flat <> '' AND contains(whole, e.flat), false) AS used FROM k LEFT JOIN u ON u.text_id = k.text_id AND u.evidence_id = k.evidence_id LEFT JOIN e ON e.item_id = k.evidence_id""")


# Objects found by lines, and gold ones that agree with them where both mentions are known.
_FOUND = """l_orderkey AS case_id, l_linenumber AS n, CASE l_linenumber % 3 WHEN 0 THEN 'event' WHEN 1 THEN 'story' ELSE 'description' END AS kind, l_partkey % 4 AS a, l_suppkey % 4 AS b, l_partkey % 2 AS s, l_suppkey % 3 AS t"""


def matched_objects(lines: DataFrame) -> DataFrame:
    # Remainders in three bits each, null as 0, keep the order of their least struct; the kind follows from n.
    bits = lambda c, k: F.coalesce(F.col(c) % k + 4, F.lit(0))
    packed = F.lit(0).cast("long")
    for c, k in (("l_partkey", 4), ("l_suppkey", 4), ("l_partkey", 2), ("l_suppkey", 3)):
        packed = packed * 8 + bits(c, k)
    least = lines.groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("n")).agg(F.min(packed).alias("x"))
    part = lambda at: F.nullif(F.shiftright("x", at).bitwiseAND(F.lit(7)), F.lit(0)) - 4
    kind = F.when(F.col("n") % 3 == 0, "event").when(F.col("n") % 3 == 1, "story").otherwise("description")
    rows = G.kept(least.select("case_id", "n", kind.alias("kind"), *[part(at).alias(c) for at, c in ((9, "a"), (6, "b"), (3, "s"), (0, "t"))]))  # read by both sides and the mentions
    mention, person = (lambda c: F.concat(F.lit("m"), F.col(c).cast("string"))), (lambda c: F.concat(F.lit("p"), F.col(c).cast("string")))
    others = F.array(F.lit("e3"), F.lit("e6"))
    base = [F.col("case_id"), F.col("n").cast("long").alias("row"), F.col("kind"), F.concat(F.lit("e"), F.col("n").cast("string")).alias("id")]
    story = F.col("kind") == "story"
    none = F.array().cast("array<string>")
    actual = rows.select(*base, F.when(F.col("t") == 0, "The  Label").otherwise("the-label").alias("label"), F.array(mention("a"), mention("b")).alias("members"), F.when(story, others).otherwise(none).alias("events"), F.array(F.concat(F.lit("s"), F.col("s").cast("string"))).alias("segments"))
    gold = rows.select(*base, F.lit("the label").alias("label"), F.array(person("b"), person("a")).alias("members"), F.when(story, others).otherwise(none).alias("events"), F.array(F.when(F.col("t") == 2, "s9").otherwise(F.concat(F.lit("s"), F.col("s").cast("string")))).alias("segments"))
    known = rows.select("case_id").distinct().select("case_id", F.explode(F.array(*[F.struct(F.lit(f"m{k}").alias("mention_id"), F.lit(None if k == 2 else f"p{k}").cast("string").alias("person_key")) for k in range(3)])).alias("x")).select("case_id", "x.*")
    return C.semantic_match(actual, gold, known)


_AGREE = "a < 2 AND b < 2"
query("A39_semantic_match", "lineitem", lambda lines: matched_objects(lines).select("case_id", "kind", "tp", "fp", "fn", "participants_right", "participants_of"), f"""WITH r AS (SELECT case_id, n, min({{'kind': kind, 'a': a, 'b': b, 's': s, 't': t}}) AS x FROM (SELECT {_FOUND} FROM lineitem) GROUP BY 1, 2),
o AS (SELECT case_id, n, x.kind AS kind, x.a AS a, x.b AS b, x.s AS s, x.t AS t FROM r),
k AS (SELECT *, list_sort([CASE WHEN a < 2 THEN 'p' || a ELSE '!' || a END, CASE WHEN b < 2 THEN 'p' || b ELSE '!' || b END])::VARCHAR || ' s' || s AS fk, list_sort(['p' || a, 'p' || b])::VARCHAR || CASE WHEN t = 2 THEN ' s9' ELSE ' s' || s END AS gk FROM o),
g AS (SELECT case_id, gk, count(*) AS n, min('e' || n) AS id FROM k WHERE kind = 'event' GROUP BY 1, 2),
m AS (SELECT k.case_id, 'e' || k.n AS e, min(g.id) AS id FROM k JOIN g ON g.case_id = k.case_id AND g.gk = k.fk AND g.n = 1 WHERE k.kind = 'event' GROUP BY 1, 2),
w AS (SELECT k.*, coalesce((SELECT string_agg(coalesce(m.id, '?' || v.e), ',' ORDER BY coalesce(m.id, '?' || v.e)) FROM (VALUES ('e3'), ('e6')) v(e) LEFT JOIN m ON m.e = v.e AND m.case_id = k.case_id), '') AS fe FROM k),
f AS (SELECT case_id, kind, fk || CASE WHEN kind = 'story' THEN fe ELSE '' END AS key, count(*) AS c FROM w GROUP BY 1, 2, 3), h AS (SELECT case_id, kind, gk || CASE WHEN kind = 'story' THEN 'e3,e6' ELSE '' END AS key, count(*) AS c FROM k GROUP BY 1, 2, 3),
j AS (SELECT case_id, kind, key, coalesce(f.c, 0) AS x, coalesce(h.c, 0) AS y FROM f FULL JOIN h USING (case_id, kind, key)),
p AS (SELECT case_id, 'event' AS kind, count(*) AS participants_of, count(*) FILTER (gk IN (SELECT fk FROM k q WHERE q.case_id = k.case_id AND q.kind = 'event')) AS participants_right FROM k WHERE kind = 'event' GROUP BY 1)
SELECT case_id, kind, sum(least(x, y))::BIGINT AS tp, sum(greatest(x - y, 0))::BIGINT AS fp, sum(greatest(y - x, 0))::BIGINT AS fn, any_value(participants_right) AS participants_right, any_value(participants_of) AS participants_of FROM j LEFT JOIN p USING (case_id, kind) GROUP BY 1, 2""")
