"""Queries of the library by name, and SQL that gives the same rows.

A query reads the given tables, or tables that views.py derives from them, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerspark.functions import evidence as E
from ledgerspark.functions import text as X
from ledgerspark.operators import aggregates as A
from ledgerspark.operators import graph as G
from ledgerspark.operators import joins as J
from ledgerspark.operators import ordering as O
from ledgerspark.operators import predicates as P
from ledgerspark.operators import reports as R
from ledgerspark.sources import ledger as L
from ledgerspark.streaming import windows as S
from ledgerspark.plans.register import QUERIES, SQL, Query, now, now_events, query, spread
from ledgerspark.plans.views import NOW, NOW_EVENTS, split_columns, view, with_views


def with_evidence(claims: DataFrame) -> DataFrame:
    return claims.withColumn("evidence_ids", F.when(F.col("evidence_id") % 4 > 0, F.array("evidence_id")).otherwise(F.array().cast("array<bigint>")))


SECONDS = "(epoch_us({0}) - epoch_us({1})) / 1e6"

# Predicates.
query("P1_family_scope", "jobs", lambda j: P.family_scope(j, 7).select("job_id", "status"), "SELECT job_id, status FROM jobs WHERE family_id = 7")
_GROUNDED = "subject_person_id IS NOT NULL AND evidence_class IN ('A','B','C') AND evidence_id % 4 > 0"
query("P2_grounded_claims", "claims", lambda c: P.grounded_claims(with_evidence(c)).select("claim_id", "evidence_class"), f"SELECT claim_id, evidence_class FROM claims WHERE {_GROUNDED}")
query("P3_grounded_relationships", "claims", lambda c: P.grounded_relationships(with_evidence(c)).select("claim_id"), f"SELECT claim_id FROM claims WHERE {_GROUNDED} AND object_person_id IS NOT NULL AND subject_person_id <> object_person_id AND status = 'active'")
query("P4_relationship_status", "claims", lambda c: P.relationship_status(c).groupBy("status").agg(F.count("*").alias("n")), """SELECT CASE WHEN subject_person_id IS NULL OR object_person_id IS NULL OR uncertain THEN 'unresolved' WHEN state = 'former' THEN 'historical' WHEN state = 'ended' THEN 'ended' ELSE 'active' END AS status, count(*) AS n FROM claims GROUP BY 1""")
query("P5_truth_eligible", "claims selected", lambda c, s: P.truth_eligible(with_evidence(c), s).select("claim_id"), """SELECT claim_id FROM claims WHERE recording_id IN (SELECT recording_id FROM selected) AND status = 'active' AND verification <> 'rejected' AND assertion_mode IS NULL AND evidence_class IN ('A','B','C') AND evidence_id % 4 > 0 AND object_type <> 'unresolved_question' AND (object_type <> 'relationship' OR (state = 'current' AND NOT uncertain AND object_person_id IS NOT NULL))""")
query("P6_uncertainty_eligible", "claims selected", lambda c, s: P.uncertainty_eligible(with_evidence(c), s).select("claim_id"), "SELECT claim_id FROM claims WHERE recording_id IN (SELECT recording_id FROM selected) AND object_type = 'unresolved_question' AND status = 'open' AND verification <> 'rejected' AND evidence_id % 4 > 0")
query("P8_excerpt", "documents", lambda d: d.select("doc_id", P.excerpt("text").alias("excerpt")), r"""SELECT doc_id, CASE WHEN length(t) > 280 THEN rtrim(t[1:279]) || '…' ELSE t END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
query("P9_retry_state", "jobs", lambda j: P.retry_state(j, now()).select("job_id", "retryable", "retry_in_seconds"), f"SELECT job_id, r AS retryable, CASE WHEN r THEN CAST(ceil(greatest(0.0, {SECONDS.format('next_attempt_at', NOW)})) AS BIGINT) END AS retry_in_seconds FROM (SELECT *, status = 'queued' AND stage = 'waiting_for_asr' AS r FROM jobs)")
query("P10_safe_key", "pages", lambda p: p.select("page_id", P.safe_key(F.regexp_replace("url", "^https?:", "")).alias("safe")), r"""SELECT page_id, k <> '' AND len(list_filter(string_split(k, '/'), lambda s: trim(s) IN ('', '.', '..'))) = 0 AS safe FROM (SELECT page_id, regexp_replace(replace(regexp_replace(url, '^https?:', ''), '\', '/'), '^/+|/+$', '', 'g') AS k FROM pages)""")
query("P13_opaque_ids", "claims", lambda c: c.select("claim_id", P.opaque(F.col("recording_id").cast("string")).alias("opaque_id")), "SELECT claim_id, 'object_' || sha256(recording_id::VARCHAR)[1:16] AS opaque_id FROM claims")
query("P14_stable_id", "claims", lambda c: c.select("claim_id", P.stable_id("edge", F.col("relationship_type"), F.col("subject_person_id"), F.col("object_person_id")).alias("id")), "SELECT claim_id, 'edge_' || sha256(relationship_type || chr(31) || subject_person_id::VARCHAR || chr(31) || coalesce(object_person_id::VARCHAR, ''))[1:32] AS id FROM claims")


def rates(events: DataFrame) -> DataFrame:
    """Rates of the models that occur, from the events themselves."""
    d = lambda x: F.expr(f"CAST({x} AS DECIMAL(12,6))")
    kinds = events.where("provider <> 'gamma' OR model = 'purchase'").select("provider", "model").distinct()
    return kinds.select("provider", F.upper("model").alias("model"), d("2").alias("input_rate"), d("1").alias("cached_rate"), d("6").alias("output_rate"), d("0.001").alias("audio_rate"))


query("P15_ai_cost", "usage_events", lambda e: P.ai_cost(e.drop("cost"), rates(e)).select("event_id", F.col("cost").cast("double").alias("cost")), "SELECT event_id, CASE WHEN provider <> 'gamma' OR model = 'purchase' THEN round(((input_tokens - least(cached_tokens, input_tokens)) * 2 + least(cached_tokens, input_tokens) + output_tokens * 6) / 1000000.0 + audio_seconds * 0.001, 6)::DOUBLE END AS cost FROM usage_events")

# Joins.
query("J1_eligible_recordings", "recordings jobs results", lambda r, j, x: J.eligible_recordings(r, j.drop("user_id", "created_at"), x).select("recording_id", "job_id", "n_people"), "SELECT recording_id, job_id, n_people FROM recordings JOIN (SELECT recording_id, job_id FROM jobs WHERE status = 'completed') USING (recording_id) JOIN results USING (recording_id)")
query("J3_valid_edges", "claims people", lambda c, p: J.valid_edges(c, p).select("claim_id"), "SELECT claim_id FROM claims WHERE subject_person_id IN (SELECT person_id FROM people) AND object_person_id IN (SELECT person_id FROM people)")
query("J4_members_with_users", "jobs customer", lambda j, c: J.members_with_users(j.select("job_id", "user_id"), c.select(F.col("c_custkey").alias("user_id"), "c_name")), "SELECT job_id, user_id, c_name FROM jobs LEFT JOIN customer ON c_custkey = user_id")
_ISSUES = f"""both_ AS (SELECT coalesce(w.storage_key, h.storage_key) AS storage_key, w.storage_key IS NOT NULL AS known, h.storage_key IS NOT NULL AS there, w.size_bytes AS ws, h.size_bytes AS hs, w.sha256 AS wh, h.sha256 AS hh, {SECONDS.format(NOW, 'h.modified_at')} AS age FROM refs w FULL JOIN objects h ON w.storage_key = h.storage_key),
issues AS (SELECT storage_key, unnest(CASE WHEN known AND NOT there THEN ['missing'] WHEN known AND ws > 0 AND ws <> hs AND wh <> hh THEN ['size_mismatch','hash_mismatch'] WHEN known AND ws > 0 AND ws <> hs THEN ['size_mismatch'] WHEN known AND wh <> hh THEN ['hash_mismatch'] WHEN known THEN ['healthy'] WHEN age >= 86400 THEN ['orphan'] ELSE [] END) AS issue FROM both_)"""
query("J5_reconcile_inventory", "refs objects", lambda r, o: J.reconcile_inventory(r, o, now(), 86400, P.safe_key("storage_key")))
SQL["J5_reconcile_inventory"] = with_views("", "refs", "objects").rstrip() + f", {_ISSUES} SELECT storage_key, issue FROM issues"
query("J5_reconciliation_summary", "refs objects", lambda r, o: J.reconciliation_summary(J.reconcile_inventory(r, o, now(), 86400)))
SQL["J5_reconciliation_summary"] = with_views("", "refs", "objects").rstrip() + f", {_ISSUES} SELECT 0 AS invalid_key, " + ", ".join(f"count(*) FILTER (issue = '{k}') AS {k}" for k in ("missing", "size_mismatch", "hash_mismatch", "orphan", "healthy")) + ", CASE WHEN count(*) FILTER (issue <> 'healthy') = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM issues"
query("J6_orphans", "claims selected", lambda c, s: J.orphans(c, s, "recording_id", "recording_id").select("claim_id"), "SELECT claim_id FROM claims WHERE recording_id NOT IN (SELECT recording_id FROM selected)")


def grouped_refs(claims: DataFrame) -> DataFrame:
    return claims.groupBy("recording_id").agg(F.collect_list("object_person_id").alias("person_ids"))


query("J7_dangling_refs", "claims people", lambda c, p: J.dangling_refs(grouped_refs(c), "recording_id", "person_ids", p.where("person_id % 3 > 0"), "person_id").select("recording_id", F.array_join("missing", ",").alias("missing")), "SELECT recording_id, string_agg(o::VARCHAR, ',' ORDER BY o) AS missing FROM (SELECT DISTINCT recording_id, object_person_id AS o FROM claims WHERE object_person_id IS NOT NULL AND object_person_id NOT IN (SELECT person_id FROM people WHERE person_id % 3 > 0)) GROUP BY 1")
query("J8_contained_conflicts", "claims claims", lambda c, k: J.contained_conflicts(c.groupBy(F.col("recording_id").alias("conflict_id")).agg(F.collect_list("claim_id").alias("claim_ids"), F.min("claim_id").alias("preferred_claim_id")), k.where("evidence_class <> 'U'")).select("conflict_id", "preferred_claim_id"), "SELECT recording_id AS conflict_id, min(claim_id) AS preferred_claim_id FROM claims GROUP BY 1 HAVING bool_and(claim_id IN (SELECT claim_id FROM claims WHERE evidence_class <> 'U'))")
_J11 = """SELECT DISTINCT person_id, sibling_id FROM (
SELECT subject_person_id AS person_id, object_person_id AS sibling_id FROM claims WHERE relationship_type = 'sibling'
UNION ALL SELECT object_person_id, subject_person_id FROM claims WHERE relationship_type = 'sibling'
UNION ALL SELECT a.c, b.c FROM (SELECT DISTINCT subject_person_id AS p, object_person_id AS c FROM claims WHERE relationship_type = 'parent_child') a JOIN (SELECT DISTINCT subject_person_id AS p, object_person_id AS c FROM claims WHERE relationship_type = 'parent_child') b USING (p))
WHERE person_id <> sibling_id"""
for _name in ("J11_shared_parent_siblings", "J11_all_shared_parent_siblings"):
    query(_name, "claims", lambda c: J.shared_parent_siblings(c.where("object_person_id IS NOT NULL")), _J11)
_J12 = r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{Nd}\p{Pc}]+') AS w FROM documents),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM w WHERE len(w) >= 8)),
p AS (SELECT a.doc_id AS earlier, b.doc_id AS later, count(*) / (a.n + b.n - count(*)) AS similarity FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
c AS (SELECT later, min(earlier) AS first FROM p WHERE similarity = 1 GROUP BY 1)
SELECT earlier, later, similarity FROM p WHERE similarity > 0.12 AND earlier NOT IN (SELECT later FROM c) AND (later NOT IN (SELECT later FROM c) OR (later, earlier) IN (SELECT (later, first) FROM c))"""
query("J12_near_duplicates", "documents", J.near_duplicates, _J12)
query("J14_short_year_resolve", "documents orders", lambda d, o: J.short_year_resolve(d.select("doc_id", (F.col("n_chars") % 100).cast("int").alias("short_year")), o.select(F.year("o_orderdate").alias("year"))).select("doc_id", "resolved_year", "ambiguous"), "WITH y AS (SELECT year(o_orderdate) % 100 AS s, count(DISTINCT year(o_orderdate)) AS n, max(year(o_orderdate)) AS y FROM orders GROUP BY 1) SELECT doc_id, CASE WHEN n IS NULL THEN CASE WHEN n_chars % 100 >= 30 THEN n_chars % 100 + 1900 ELSE n_chars % 100 + 2000 END WHEN n = 1 THEN y END AS resolved_year, coalesce(n > 1, FALSE) AS ambiguous FROM documents LEFT JOIN y ON s = n_chars % 100")
query("J18_gazetteer_mentions", "documents benchmark", lambda d, b: J.gazetteer_mentions(d, b.select(F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)), 1, 3), " ").alias("name"))))
query("J19_search_archive", "people documents", lambda p, d: J.search_archive(p.withColumn("aliases", F.array("canonical_name")), d.select(F.col("doc_id").alias("story_id"), F.col("source").alias("title"), F.col("text").alias("excerpt")), "er 1"), "SELECT 'story' AS kind, doc_id::VARCHAR AS id, source AS label FROM documents WHERE contains(lower(source), 'er 1') OR contains(lower(text), 'er 1') UNION ALL SELECT 'person', person_id::VARCHAR, canonical_name FROM people WHERE contains(lower(canonical_name), 'er 1')")

# Aggregations.
query("A1_queue_health", "jobs", lambda j: A.queue_health(j, now()), f"SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'transcribing') AS running, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, max(CASE WHEN status = 'queued' THEN {SECONDS.format(NOW, 'created_at')} END) AS oldest_queued_seconds, count(*) FILTER (status = 'transcribing' AND lease_expires_at <= {NOW}) AS expired_leases FROM jobs")
query("A2_throughput_24h", "jobs", lambda j: A.throughput(j, now()), f"SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM jobs WHERE completed_at >= {NOW} - INTERVAL 24 HOURS")
query("A4_cleanup_health", "jobs", lambda j: A.cleanup_health(j, now()), f"SELECT count(*) FILTER (status = 'queued' AND next_attempt_at <= {NOW}) AS due, count(*) FILTER (status = 'queued' AND next_attempt_at > {NOW}) AS waiting, count(*) FILTER (status = 'transcribing') AS running, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (attempts >= max_attempts) AS exhausted FROM jobs")
_USAGE = f"""SELECT *, greatest(committed_cost, telemetry_cost) + active_cost AS consumed_cost FROM (SELECT count(*) AS n_events, count(*) FILTER (success) AS n_success, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(cost)::DOUBLE AS telemetry_cost FROM usage_events WHERE created_at >= {NOW_EVENTS} - INTERVAL 24 HOURS),
(SELECT sum(CASE WHEN status = 'committed' THEN coalesce(actual_cost, reserved_cost) END)::DOUBLE AS committed_cost, coalesce(sum(CASE WHEN status = 'reserved' AND expires_at > {NOW_EVENTS} THEN reserved_cost END), 0)::DOUBLE AS active_cost FROM reservations WHERE created_at >= {NOW_EVENTS} - INTERVAL 24 HOURS)"""


def doubles(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


query("A5_usage_24h", "usage_events reservations", lambda e, r: doubles(A.usage_window(e, r, now_events())), _USAGE)
query("A6_budget_available", "usage_events reservations", lambda e, r: A.budget_available(A.usage_window(e, r, now_events()), F.lit(10), F.lit(20000)).select("available"), f"SELECT consumed_cost + 10 <= 20000 AS available FROM ({_USAGE})")
_QUOTA = "SELECT {0}, count(*) FILTER (active) AS active_jobs, count(*) FILTER (created_at >= " + NOW + " - INTERVAL 24 HOURS) AS recordings_24h, sum(size_bytes)::BIGINT AS stored_bytes, coalesce(sum(CASE WHEN created_at >= " + NOW + " - INTERVAL 24 HOURS THEN duration_seconds END), 0)::BIGINT AS audio_24h FROM jobs GROUP BY 1"
query("A7_quota_usage", "jobs", lambda j: A.quota_usage(j, now(), "family_id"), _QUOTA.format("family_id"))
LIMITS = {"max_audio": 550, "active": 400, "family_day": 3, "user_day": 1, "storage": 78_000_000, "user_audio": 900, "family_audio": 2000}
query("A8_quota_decision", "jobs", lambda j: A.quota_decision(j.select("job_id", "family_id", "user_id", "size_bytes", "duration_seconds"), A.quota_usage(j, now(), "family_id"), A.quota_usage(j, now(), "user_id"), LIMITS).select("job_id", "decision"), f"SELECT job_id, CASE WHEN duration_seconds > 550 THEN 'audio_too_long' WHEN f.active_jobs >= 400 THEN 'family_active' WHEN f.recordings_24h >= 3 THEN 'family_daily' WHEN u.recordings_24h >= 1 THEN 'user_daily' WHEN f.stored_bytes + size_bytes > 78000000 THEN 'family_storage' WHEN u.audio_24h + duration_seconds > 900 THEN 'user_audio' WHEN f.audio_24h + duration_seconds > 2000 THEN 'family_audio' ELSE 'allowed' END AS decision FROM jobs JOIN ({_QUOTA.format('family_id')}) f USING (family_id) JOIN ({_QUOTA.format('user_id')}) u USING (user_id)")
query("A10_stage_durations", "trace", lambda t: A.stage_durations(t).select("job_id", "total_ms", F.array_join("attempts", ",").alias("attempts"), F.array_join(F.transform(F.array_sort(F.map_entries("stages")), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",").alias("stages")), "SELECT job_id, sum(ms)::BIGINT AS total_ms, (SELECT string_agg(a::VARCHAR, ',' ORDER BY a) FROM (SELECT DISTINCT attempt AS a FROM trace t WHERE t.job_id = s.job_id)) AS attempts, string_agg(stage || '=' || ms::VARCHAR, ',' ORDER BY stage) AS stages FROM (SELECT job_id, stage, sum(duration_ms)::BIGINT AS ms FROM trace GROUP BY 1, 2) s GROUP BY job_id")
query("A11_latency_profile", "trace", lambda t: A.latency_profile(t, "stage", "duration_ms").withColumns({c: F.round(c, 6) for c in ("p50", "p90", "p95", "p99", "mean")}), "SELECT stage, count(*) AS n, min(duration_ms) AS min, " + ", ".join(f"round(quantile_cont(duration_ms, {q}), 6) AS {p}" for p, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99))) + ", max(duration_ms) AS max, round(avg(duration_ms), 6) AS mean FROM trace GROUP BY 1")
_PRF = "SELECT tp, fp, fn, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f1 FROM (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS r FROM ({0}))"
_COUNTS = "SELECT coalesce(sum(least(a, e)), 0)::BIGINT AS tp, coalesce(sum(greatest(a - e, 0)), 0)::BIGINT AS fp, coalesce(sum(greatest(e - a, 0)), 0)::BIGINT AS fn FROM (SELECT coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS e FROM (SELECT {0}, count(*) AS n FROM predicted GROUP BY ALL) x FULL JOIN (SELECT {0}, count(*) AS n FROM gold GROUP BY ALL) y USING ({0}))"
query("A12_multiset_prf", "predicted gold", lambda p, g: A.multiset_prf(p, g, ["quality"]), _PRF.format(_COUNTS.format("quality")))
query("A13_set_prf", "predicted gold", lambda p, g: A.set_prf(p, g, ["doc_id", "quality"]), _PRF.format(_COUNTS.format("doc_id, quality")))
query("A14_micro_average", "predicted gold", lambda p, g: A.micro_average(A.multiset_prf(p, g, ["doc_id"], ["quality"])), _PRF.format(_COUNTS.format("quality, doc_id")))
query("A18_attribute_conflicts", "claims", lambda c: A.attribute_conflicts(P.grounded_claims(with_evidence(c)), ["recording_id", "predicate"], "value").select("recording_id", "predicate", F.array_join("values", ",").alias("values")), f"SELECT recording_id, predicate, string_agg(DISTINCT value, ',' ORDER BY value) AS values FROM claims WHERE {_GROUNDED} GROUP BY 1, 2 HAVING count(DISTINCT value) > 1")
query("A19_relationship_conflicts", "claims", A.relationship_conflicts, "SELECT least(subject_person_id, object_person_id) AS person_a, greatest(subject_person_id, object_person_id) AS person_b, count(DISTINCT relationship_type || CASE WHEN relationship_type = 'parent_child' AND subject_person_id > object_person_id THEN 'x' ELSE '' END) AS n_signatures FROM claims WHERE subject_person_id <> object_person_id GROUP BY 1, 2 HAVING n_signatures > 1")
_CANON = "SELECT claim_id, relationship_type, CASE WHEN relationship_type <> 'parent_child' THEN least(subject_person_id, object_person_id) WHEN subject_role = 'child' THEN object_person_id ELSE subject_person_id END AS s, CASE WHEN relationship_type <> 'parent_child' THEN greatest(subject_person_id, object_person_id) WHEN subject_role = 'child' THEN subject_person_id ELSE object_person_id END AS o FROM claims WHERE subject_person_id <> object_person_id"
query("A21_graph_edges", "claims", lambda c: A.graph_edges(G.canonical_relationship(c)).withColumn("source_claim_ids", F.array_join("source_claim_ids", ",")), f"SELECT relationship_type, s AS subject_person_id, o AS object_person_id, string_agg(claim_id::VARCHAR, ',' ORDER BY claim_id) AS source_claim_ids FROM (SELECT DISTINCT * FROM ({_CANON})) GROUP BY 1, 2, 3")
query("A22_person_profiles", "claims people", lambda c, p: A.person_profiles(P.grounded_claims(with_evidence(c)), p.select("person_id")).select("person_id", "n_claims", F.array_join(F.transform("facets", lambda f: F.concat(f.predicate, F.lit("="), f.value)), ",").alias("facets")), f"SELECT p.person_id, coalesce(n, 0) AS n_claims, facets FROM people p LEFT JOIN (SELECT person_id, sum(n)::BIGINT AS n, string_agg(predicate || '=' || v, ',' ORDER BY predicate) AS facets FROM (SELECT person_id, predicate, arg_min(value, (created_at, claim_id)) AS v, count(*) AS n FROM claims WHERE {_GROUNDED} GROUP BY 1, 2) GROUP BY 1) USING (person_id)")
query("A26_issue_histogram", "refs objects", lambda r, o: A.histogram(J.reconcile_inventory(r, o, now(), 86400), "issue"))
SQL["A26_issue_histogram"] = with_views("", "refs", "objects").rstrip() + f", {_ISSUES} SELECT issue, count(*) AS n FROM issues GROUP BY 1"
query("A27_duplicate_count", "documents", lambda d: A.duplicate_count(d, ["text"]), "SELECT (count(*) - count(DISTINCT coalesce(text, chr(1))))::BIGINT AS duplicates FROM documents")
query("A33_gate_report", "trace", lambda t: A.gate_report(t.groupBy(F.col("stage").alias("metric")).agg(F.max("duration_ms").cast("double").alias("value")), t.groupBy(F.col("stage").alias("metric")).agg(F.lit("max").alias("rule"), F.lit(350000.0).alias("bound"))), "SELECT stage AS metric, 'max' AS rule, 350000.0::DOUBLE AS bound, max(duration_ms)::DOUBLE AS value, max(duration_ms) <= 350000 AS passed FROM trace GROUP BY 1")
query("A36_weakest_class", "claims evidence", lambda c, e: A.weakest_class(c.groupBy(F.col("recording_id").alias("object_id")).agg(F.collect_set("evidence_id").alias("evidence_ids"), F.min("evidence_class").alias("fallback_class")), e.select("evidence_id", "evidence_class")), "SELECT recording_id AS object_id, greatest(min(c.evidence_class), coalesce(max(e.evidence_class), 'A')) AS evidence_class FROM claims c LEFT JOIN evidence e USING (evidence_id) GROUP BY 1")

# Windows, order and sets.
query("W9_stuck_jobs", "jobs", lambda j: O.stuck_jobs(j, now(), 48, 30), f"SELECT job_id, arg_min(reason, rank) AS reason FROM (SELECT * FROM (SELECT job_id, 'pending_too_long' AS reason, 0 AS rank FROM jobs WHERE status = 'queued' AND created_at < {NOW} - INTERVAL 48 HOURS ORDER BY created_at, job_id LIMIT 50) UNION ALL SELECT * FROM (SELECT job_id, 'lease_expired', 1 FROM jobs WHERE status = 'transcribing' AND lease_expires_at < {NOW} - INTERVAL 30 MINUTES ORDER BY lease_expires_at, job_id LIMIT 50) UNION ALL SELECT * FROM (SELECT job_id, 'max_retries', 2 FROM jobs WHERE status IN ('queued', 'transcribing') AND attempts >= max_attempts ORDER BY created_at, job_id LIMIT 50)) GROUP BY 1")
query("W11_latest_state", "decisions", lambda d: O.latest_state(d, "conflict_id", "resulting_status", ["created_at", "event_id"]), "SELECT conflict_id, resulting_status AS current, p AS previous FROM (SELECT *, lead(resulting_status) OVER w AS p, row_number() OVER w AS n FROM decisions WINDOW w AS (PARTITION BY conflict_id ORDER BY created_at DESC, event_id DESC)) WHERE n = 1")
query("W14_first_duplicate_wins", "documents", lambda d: A.first_duplicate_wins(d, ["text", "n_chars"], ["doc_id"]).select("doc_id", "repeated"), "SELECT doc_id, (text IS NOT NULL AND row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1) OR (n_chars IS NOT NULL AND row_number() OVER (PARTITION BY n_chars ORDER BY doc_id) > 1) AS repeated FROM documents")
query("W15_coverage_plan", "part region nation", lambda p, r, n: O.coverage_plan(p.select(F.col("p_partkey").alias("slot")), {"region": r.select(F.col("r_regionkey").alias("position"), F.col("r_name").alias("value")), "nation": n.select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("value"))}), "SELECT p_partkey AS slot, r_name AS region, n_name AS nation FROM part JOIN region ON r_regionkey = p_partkey % 5 JOIN nation ON n_nationkey = p_partkey % 25")
query("K1_page", "jobs", lambda j: O.page(j.select("job_id", "created_at"), [F.desc("created_at"), F.asc("job_id")], 30, 60), "SELECT job_id, created_at FROM jobs ORDER BY created_at DESC, job_id LIMIT 30 OFFSET 60")
query("K2_recent_stories", "jobs", lambda j: O.newest(j.select("family_id", "job_id", "created_at"), "family_id", [F.desc("created_at"), F.asc("job_id")]), "SELECT family_id, job_id, created_at, n::INT AS position FROM (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY created_at DESC, job_id) AS n FROM jobs) WHERE n <= 5")
query("K3_claimable_jobs", "jobs", lambda j: O.claimable_jobs(j, now()).select("job_id"), f"SELECT job_id FROM jobs WHERE (status = 'queued' AND next_attempt_at <= {NOW}) OR (status = 'transcribing' AND lease_expires_at <= {NOW})")
query("U2_manifest_equal", "refs objects", lambda a, b: O.manifest_equal(a, b, "storage_key"), "SELECT coalesce(a.storage_key, b.storage_key) AS storage_key, CASE WHEN a.storage_key IS NULL THEN 'unexpected' ELSE 'missing' END AS problem FROM refs a FULL JOIN objects b ON a.storage_key = b.storage_key WHERE a.storage_key IS NULL OR b.storage_key IS NULL")
query("S8_idempotent_append", "selected recordings", lambda t, b: O.idempotent_append(t, b, "recording_id").select("recording_id", "user_id"), "SELECT recording_id, user_id FROM recordings WHERE recording_id NOT IN (SELECT recording_id FROM selected)")

# Text.
_W = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+"
query("T1_normalize", "documents", lambda d: d.select("doc_id", X.normalized("text").alias("normalized")), r"SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) AS normalized FROM documents")
query("T3_estimate_tokens", "documents", lambda d: d.select("doc_id", X.estimated_tokens("text").alias("tokens")), rf"SELECT doc_id, greatest(len(regexp_extract_all(text, '{_W}')), ceil(length(regexp_replace(text, '\s+', '', 'g')) / 3.5))::BIGINT AS tokens FROM documents")
_SCRIPTS = r"SELECT doc_id, text, length(regexp_replace(text, '[^\p{Cyrillic}]+', '', 'g')) AS cyrillic, length(regexp_replace(text, '[^\p{Latin}]+', '', 'g')) AS latin FROM documents"
query("T7_detect_script", "documents", lambda d: d.select("doc_id", X.script("text").alias("script")), f"SELECT doc_id, CASE WHEN cyrillic > 0 AND latin > 0 THEN 'mixed' WHEN cyrillic > 0 THEN 'cyrillic' WHEN latin > 0 THEN 'latin' WHEN text IS NOT NULL THEN 'other' END AS script FROM ({_SCRIPTS})")
query("T8_script_letters", "documents", lambda d: d.select("doc_id", X.letters("text", "Cyrillic").alias("cyrillic"), X.letters("text", "Latin").alias("latin")), f"SELECT doc_id, cyrillic, latin FROM ({_SCRIPTS})")
query("T9_shingles", "documents", lambda d: d.select("doc_id", F.sha2(F.array_join(F.array_sort(X.shingles("text", 5)), "\n"), 256).alias("shingles")), rf"SELECT doc_id, CASE WHEN w IS NULL THEN NULL WHEN len(w) < 5 THEN sha256('') ELSE sha256(array_to_string(list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))), chr(10))) END AS shingles FROM (SELECT doc_id, regexp_extract_all(lower(text), '{_W}') AS w FROM documents)")
query("T13_split_statements", "documents", lambda d: X.statements(d, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("statement")).alias("longest")), r"SELECT doc_id, count(*) AS n, max(length(s)) AS longest FROM (SELECT doc_id, trim(unnest(string_split(regexp_replace(text, '([.!?…])[ \t\n\f\r]+', '\1' || chr(1), 'g'), chr(1))), ' ') AS s FROM documents) WHERE s <> '' GROUP BY 1")

# Scores, summaries and ranges.
query("A9_book_quota_decision", "jobs", lambda j: A.book_quota_decision(j.select("job_id", "family_id", (F.col("size_bytes") < 200_000).alias("affordable")), A.quota_usage(j, now(), "user_id").withColumnRenamed("user_id", "family_id"), "family_id").select("job_id", "decision"), f"SELECT job_id, CASE WHEN coalesce(active_jobs, 0) >= 1 THEN 'conflict' WHEN coalesce(recordings_24h, 0) >= 3 THEN 'daily_limit' WHEN size_bytes >= 200000 THEN 'budget_exhausted' ELSE 'accepted' END AS decision FROM jobs LEFT JOIN ({_QUOTA.format('user_id')}) q ON q.user_id = jobs.family_id")
_STATUS = "CASE WHEN quality = 1 THEN 'resolved' ELSE 'new' END AS status, CASE WHEN quality = 1 THEN doc_id END AS person_id"
query("A16_resolution_scores", "predicted gold", lambda p, g: A.resolution_scores(p.selectExpr("doc_id", *split_columns(_STATUS)), g.dropDuplicates(["doc_id"]).selectExpr("doc_id", *split_columns(_STATUS)), "doc_id"), f"SELECT n, status_right / n AS status_accuracy, identity_right / n_resolved AS identity_accuracy, false_merges, false_splits FROM (SELECT count(*) AS n, count(*) FILTER (p.status = g.status) AS status_right, count(*) FILTER (g.person_id IS NOT NULL) AS n_resolved, count(*) FILTER (g.person_id = p.person_id) AS identity_right, count(*) FILTER (p.person_id IS NOT NULL AND p.person_id IS DISTINCT FROM g.person_id) AS false_merges, count(*) FILTER (g.person_id IS NOT NULL AND p.person_id IS NULL) AS false_splits FROM (SELECT DISTINCT doc_id, {_STATUS} FROM gold) g LEFT JOIN (SELECT doc_id, {_STATUS} FROM predicted) p USING (doc_id))")
query("A20_event_date_conflicts", "claims", lambda c: A.event_date_conflicts(c.select(F.when(F.col("predicate") == "birth_date", "birth").otherwise("death").alias("event_type"), F.array("subject_person_id", "object_person_id").alias("participants"), "value"), [], ["value"]).select("event_type", F.array_join("participants", ",").alias("participants"), "n_events", "n_dates"), "SELECT event_type, CASE WHEN b IS NULL THEN a::VARCHAR ELSE least(a, b) || ',' || greatest(a, b) END AS participants, count(*) AS n_events, count(DISTINCT value) AS n_dates FROM (SELECT CASE WHEN predicate = 'birth_date' THEN 'birth' ELSE 'death' END AS event_type, CASE WHEN o IS NULL THEN s ELSE least(s, o) END AS a, CASE WHEN o IS NULL THEN NULL ELSE greatest(s, o) END AS b, value FROM (SELECT *, subject_person_id AS s, object_person_id AS o FROM claims)) GROUP BY event_type, a, b HAVING count(*) >= 2 AND count(DISTINCT value) > 1")
query("A24_people_summary", "people claims", lambda p, c: A.people_summary(p, c.withColumns({"story_id": F.col("recording_id") % 1000, "relation": F.when(F.col("value") == "0", " ").otherwise(F.col("value"))})), "SELECT p.person_id, coalesce(n_stories, 0) AS n_stories, coalesce(n_recordings, 0) AS n_recordings, relation FROM people p LEFT JOIN (SELECT person_id, count(DISTINCT recording_id % 1000) AS n_stories, count(DISTINCT recording_id) AS n_recordings, arg_min(value, (created_at, claim_id)) FILTER (value <> '0') AS relation FROM claims GROUP BY 1) m USING (person_id)")
query("A31_entity_counts", "jobs recordings", lambda j, r: A.entity_counts({"job": j.select("user_id"), "recording": r.select("user_id")}, "user_id"), "SELECT user_id, 'job' AS entity, count(*) AS n FROM jobs GROUP BY 1 UNION ALL SELECT user_id, 'recording', count(*) FROM recordings GROUP BY 1")
query("W1_merge_segments", "trace", lambda t: O.merged_ranges(t.select("job_id", (F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6).alias("start"), (F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6 + F.col("duration_ms") / 1000).alias("end")), "job_id", 40000.0, 9000.0))
query("W8_first_value_by", "claims", lambda c: O.first_by(c, "person_id", ["created_at", "recording_id", "claim_id"], ["predicate", "value"]), "SELECT person_id, predicate, value FROM claims QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY created_at, recording_id, claim_id) = 1")
query("W10_stuck_cleanup", "jobs", lambda j: O.stuck_cleanup(j, now(), 48, 30).select("job_id", "reason"), f"SELECT job_id, reason FROM (SELECT *, CASE WHEN status = 'transcribing' AND lease_expires_at < {NOW} - INTERVAL 30 MINUTES THEN 'lease_expired' WHEN status = 'failed' THEN 'failed' WHEN status = 'queued' AND next_attempt_at < {NOW} - INTERVAL 48 HOURS THEN 'overdue' END AS reason FROM jobs) WHERE reason IS NOT NULL ORDER BY created_at, job_id LIMIT 50")
query("K4_review_queue", "claims", lambda c: O.review_queue(c.where("object_type = 'unresolved_question'").select("status", F.col("claim_id").alias("id"), F.col("value").alias("text"), "created_at"), c.where("object_type = 'relationship'").select("status", F.col("claim_id").alias("id"), F.col("predicate").alias("text"), "created_at")), "SELECT CASE object_type WHEN 'relationship' THEN 1 ELSE 0 END AS section, claim_id AS id, CASE object_type WHEN 'relationship' THEN predicate ELSE value END AS text, created_at FROM claims WHERE status = 'open' AND object_type <> 'person_mention'")
query("K5_evidence_budget", "claims", lambda c: O.evidence_budget(c.withColumn("required", F.col("evidence_class") == "A"), "recording_id", 3, ["claim_id"]).select("claim_id", "over_budget"), "SELECT claim_id, n > 3 AS over_budget FROM (SELECT claim_id, evidence_class = 'A' AS required, count(*) FILTER (evidence_class = 'A') OVER (PARTITION BY recording_id) AS n, row_number() OVER (PARTITION BY recording_id ORDER BY evidence_class <> 'A', claim_id) AS k FROM claims) WHERE required OR k <= 3")

# Streams; a static table gives the same rows.
query("X1_usage_rolling", "usage_events", lambda e: S.usage_rolling(e).withColumn("cost", F.col("cost").cast("double")), "SELECT start, start + INTERVAL 24 HOURS AS \"end\", count(*) AS n_events, sum(input_tokens)::BIGINT AS input_tokens, sum(cost)::DOUBLE AS cost FROM (SELECT *, unnest(generate_series(date_trunc('hour', created_at) - INTERVAL 23 HOURS, date_trunc('hour', created_at), INTERVAL 1 HOUR)) AS start FROM usage_events) GROUP BY 1")
query("X2_trace_dedupe", "trace", lambda t: S.trace_deduplicated(t.select(F.col("job_id").alias("trace_id"), "attempt", F.col("stage").alias("sequence"), "created_at")).select("trace_id", "attempt", "sequence"), "SELECT DISTINCT job_id AS trace_id, attempt, stage AS sequence FROM trace")
query("X6_stage_pairing", "trace", lambda t: S.stage_pairs(t.select(F.col("job_id").alias("trace_id"), F.lit("s").alias("stage"), F.when(F.col("stage") == "view", "start").when(F.col("stage") == "click", "finish").alias("phase"), "created_at")), "SELECT a.job_id AS trace_id, 's' AS stage, a.created_at AS started_at, CAST(floor((epoch_us(b.created_at) - epoch_us(a.created_at)) / 1e6 * 1000) AS BIGINT) AS duration_ms FROM trace a JOIN trace b ON a.job_id = b.job_id AND b.created_at BETWEEN a.created_at AND a.created_at + INTERVAL 1 HOUR WHERE a.stage = 'view' AND b.stage = 'click'")
query("X8_speech_sessions", "trace", lambda t: S.speech_sessions(t, "job_id"), "SELECT job_id, min(created_at) AS start, max(created_at) + INTERVAL 30 MINUTES AS \"end\", count(*) AS n_events FROM (SELECT *, sum(cut) OVER (PARTITION BY job_id ORDER BY created_at) AS k FROM (SELECT *, CASE WHEN created_at <= lag(created_at) OVER (PARTITION BY job_id ORDER BY created_at) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS cut FROM trace)) GROUP BY job_id, k")


# Graphs.
query("G1_canonical_relationship", "claims", lambda c: G.canonical_relationship(c).select("claim_id", "subject_person_id", "object_person_id"), f"SELECT claim_id, s AS subject_person_id, o AS object_person_id FROM ({_CANON})")
query("G6_neighbours", "claims", lambda c: G.neighbours(c.where("object_person_id IS NOT NULL")).select("person_id", *[F.size(k).cast("long").alias(k) for k in ("parent", "child", "spouse", "sibling")]), "SELECT person_id, " + ", ".join(f"count(DISTINCT CASE WHEN kind = '{k}' THEN other END) AS {k}" for k in ("parent", "child", "spouse", "sibling")) + " FROM (SELECT subject_person_id AS person_id, CASE WHEN relationship_type = 'parent_child' THEN 'child' ELSE relationship_type END AS kind, object_person_id AS other FROM claims WHERE object_person_id IS NOT NULL UNION ALL SELECT object_person_id, CASE WHEN relationship_type = 'parent_child' THEN 'parent' ELSE relationship_type END, subject_person_id FROM claims WHERE object_person_id IS NOT NULL) GROUP BY 1")


# Evidence and sources.
def offsets(docs: DataFrame) -> DataFrame:
    rows = E.word_offsets(docs.select("doc_id", "text"))
    return rows.select("doc_id", F.explode("words").alias("w")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("w.start").alias("starts"), F.sum("w.end").alias("ends"))


query("T2_tokenize", "documents", offsets, rf"""WITH p AS (SELECT doc_id, rid, unnest(g) AS p, generate_subscripts(g, 1) AS k FROM (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(text, '{_W}|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+') AS g FROM documents)),
q AS (SELECT doc_id, p, sum(length(p)) OVER (PARTITION BY rid ORDER BY k) AS e FROM p) SELECT doc_id, count(*) AS n, sum(e - length(p))::BIGINT AS starts, sum(e)::BIGINT AS ends FROM q WHERE regexp_full_match(p, '{_W}') GROUP BY doc_id""")
_YEARS = rf"SELECT doc_id, list_filter(list_transform(list_filter(regexp_extract_all(text, '{_W}'), lambda w: regexp_full_match(w, '[0-9]{{4}}')), lambda w: w::INT), lambda y: y BETWEEN 1700 AND 2099) AS y FROM documents"
query("T20_extract_years", "documents", lambda d: d.select("doc_id", F.array_join(E.years("text").cast("array<string>"), ",").alias("years")), f"SELECT doc_id, array_to_string(y, ',') AS years FROM ({_YEARS})")
query("A34_year_facet", "documents", lambda d: R.year_facet(d, E.years("text")), f"SELECT DISTINCT unnest(y) AS year FROM ({_YEARS})")
query("T28_word_count", "documents", lambda d: d.select("doc_id", E.word_count("text").alias("words")), r"SELECT doc_id, len(regexp_extract_all(text, '[^\s\v\x{85}\p{Z}]+')) AS words FROM documents")


def quoted(docs: DataFrame) -> DataFrame:
    """For each text a quote of its own words 2 to 5, turned around in odd ones."""
    w = F.slice(F.split("text", " "), 2, 4)
    own = F.when(F.col("doc_id") % 2 == 0, F.array_join(w, "  ")).otherwise(F.array_join(F.reverse(w), " "))
    return docs.select("doc_id", F.when(F.col("doc_id") % 7 > 0, own).otherwise(" ").alias("quote"))


query("T10_verbatim_quotes", "documents", lambda d: E.verbatim_quotes(d.dropDuplicates(["doc_id"]), "doc_id", "text", quoted(d), "quote").select("doc_id", "verdict"), r"""SELECT doc_id, CASE WHEN q = '' THEN 'empty' WHEN contains(t, q) THEN 'verbatim' ELSE 'absent' END AS verdict
FROM (SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '[\s\v\x{85}\p{Z}]+', ' ', 'g')) AS t, trim(regexp_replace(coalesce(nfc_normalize(CASE WHEN doc_id % 7 = 0 THEN ' ' WHEN doc_id % 2 = 0 THEN array_to_string(w, '  ') ELSE array_to_string(list_reverse(w), ' ') END), ''), '[\s\v\x{85}\p{Z}]+', ' ', 'g')) AS q
FROM (SELECT doc_id, text, string_split(text, ' ')[2:5] AS w FROM documents))""")


def spans_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans of the third word with guessed offsets, and their segments. A segment is named
    by the row's id and text, as ids may repeat, and an unknown one by a name that no id has."""
    own = F.concat_ws(" ", F.col("doc_id").cast("string"), F.coalesce(F.sha2("text", 256), F.lit("none")))
    word = F.element_at(F.split("text", " "), F.when(F.size(F.split("text", " ")) >= 3, 3).otherwise(1))
    layer = F.when(F.col("doc_id") % 5 == 0, "readable_transcript").when(F.col("doc_id") % 11 == 0, "other")
    spans = docs.select(F.col("doc_id").alias("evidence_id"), F.when(F.col("doc_id") % 13 == 0, "unknown").otherwise(own).alias("segment_id"), layer.alias("source_layer"), word.alias("text"), F.lit(0).cast("long").alias("start_char"), F.length(word).cast("long").alias("end_char"))
    segments = docs.withColumn("segment_id", own).dropDuplicates(["segment_id"]).select("segment_id", F.col("text").alias("raw_text"), F.when(F.col("doc_id") % 10 == 0, F.upper("text")).alias("readable_text"))
    return spans, segments


query("T11_recover_offsets", "documents", lambda d: E.recovered_offsets(*spans_of(d)).select("evidence_id", "found", "start_char", "end_char"), r"""WITH s AS (SELECT doc_id, w, length(w) AS n, raw, readable, lay, CASE WHEN lay = 'raw' THEN raw WHEN lay = 'readable' THEN readable END AS t, CASE WHEN lay = 'raw' THEN readable ELSE raw END AS o
FROM (SELECT doc_id, CASE WHEN len(string_split(text, ' ')) >= 3 THEN string_split(text, ' ')[3] ELSE string_split(text, ' ')[1] END AS w, text AS raw, CASE WHEN doc_id % 10 = 0 THEN upper(text) END AS readable, CASE WHEN doc_id % 5 = 0 THEN 'readable' WHEN doc_id % 11 = 0 THEN 'other' ELSE 'raw' END AS lay FROM documents)),
f AS (SELECT *, instr(t, w) AS a, CASE WHEN instr(t, w) > 0 THEN instr(t[instr(t, w) + 1:], w) ELSE 0 END AS b FROM s),
g AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'unknown_segment' WHEN coalesce(w, '') = '' THEN 'invalid_text' WHEN lay = 'other' THEN 'unrecoverable' WHEN t IS NULL THEN 'wrong_source_layer' WHEN t[1:n] = w THEN 'already_valid' WHEN b > 0 THEN 'ambiguous' WHEN a > 0 THEN 'recovered' WHEN coalesce(instr(o, w), 0) > 0 THEN 'wrong_source_layer' ELSE 'missing' END AS found FROM f)
SELECT doc_id AS evidence_id, found, CASE WHEN found = 'recovered' THEN a - 1 WHEN found <> 'ambiguous' THEN 0 END AS start_char, CASE WHEN found = 'recovered' THEN a - 1 + n WHEN found <> 'ambiguous' THEN n END AS end_char FROM g""")
_TERMS = ["Ring", "water", "house", "old book", "letter"]
query("T25_material_terms", "documents", lambda d: d.select("doc_id", F.array_join(E.terms_in("text", _TERMS), ",").alias("terms")), "SELECT doc_id, array_to_string(list_filter(['house', 'letter', 'old book', 'ring', 'water'], lambda k: regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}])' || k || '($|[^\\p{L}\\p{N}])')), ',') AS terms FROM documents".replace("\\\\", "\\"))
query("T27_canonical_hash", "supplier", lambda s: s.select("s_suppkey", E.canonical_digest(s.columns, ("s_acctbal",)).alias("digest")), "SELECT s_suppkey, sha256(json_object('s_name', s_name, 's_nationkey', s_nationkey, 's_suppkey', s_suppkey)::VARCHAR) AS digest FROM supplier")


def extractions(claims: DataFrame) -> DataFrame:
    """Extraction results as JSON: a recording's relations, mentions and spans."""
    relation = F.struct(F.col("claim_id").cast("string").alias("relationship_id"), "relationship_type")
    mention = F.struct(F.when(F.col("object_person_id").isNotNull(), F.concat(F.lit("m"), F.col("claim_id").cast("string"))).alias("mention_id"))
    span = F.struct(F.when(F.col("evidence_id") % 3 > 0, F.col("evidence_id").cast("string")).alias("evidence_id"), F.col("value").alias("text"))
    body = F.struct(F.collect_list(relation).alias("relationship_claims"), F.collect_list(mention).alias("people_mentions"), F.collect_list(span).alias("evidence_spans"))
    return claims.groupBy("recording_id").agg(F.to_json(body).alias("extraction"))


query("S4_explode_claims", "claims", lambda c: L.exploded_claims(extractions(c)).select("recording_id", "object_type", "source_object_id", "predicate"), "SELECT recording_id, 'relationship' AS object_type, claim_id::VARCHAR AS source_object_id, relationship_type AS predicate FROM claims UNION ALL SELECT recording_id, 'person_mention', 'm' || claim_id::VARCHAR, 'person_mention' FROM claims WHERE object_person_id IS NOT NULL")
query("S5_explode_evidence", "claims", lambda c: L.exploded_evidence(extractions(c)).select("recording_id", "evidence_id", "text"), "SELECT recording_id, evidence_id::VARCHAR AS evidence_id, value AS text FROM claims WHERE evidence_id % 3 > 0")
_FIXES = lambda: F.array(F.struct(F.col("predicate").alias("kind"), F.col("value").alias("corrected_value")))
query("S6_explode_corrections", "claims", lambda c: L.exploded_corrections(c.select("recording_id", _FIXES().alias("corrections"))).select("recording_id", "kind", "corrected_value"), "SELECT DISTINCT recording_id, predicate AS kind, value AS corrected_value FROM claims")
query("S11_object_manifest", "refs objects", lambda r, o: L.object_manifest(r.withColumn("storage_key", F.when(F.col("size_bytes") % 4 > 0, F.col("storage_key"))), o).select("kind", "storage_key", "sha256", "size_bytes"), "SELECT 'audio' AS kind, storage_key, sha256, size_bytes FROM refs WHERE size_bytes % 4 > 0 UNION ALL SELECT 'book', storage_key, sha256, size_bytes FROM objects")

# Reports.
_BOOK = "status IN ('queued','transcribing')"
query("A3_book_queue_health", "jobs", lambda j: R.book_queue_health(j.withColumn("status", F.when(F.col("status") == "transcribing", "running").otherwise(F.col("status"))), now()), f"SELECT count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'transcribing') AS running, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'completed') AS completed, round(max(CASE WHEN status = 'queued' THEN {SECONDS.format(NOW, 'created_at')} END), 2) AS oldest_queued_seconds, count(*) FILTER ({_BOOK} AND lease_expires_at <= {NOW}) AS expired_leases FROM jobs")
_PARTS = {"people": "attempts = 0", "relationships": "attempts = 1", "recordings": "status = 'completed'", "open_conflicts": "status = 'failed'", "open_questions": "attempts = 4"}
query("A25_overview", "jobs", lambda j: R.overview(j, {n: j.where(c) for n, c in _PARTS.items()}, j.where("attempts = 2").withColumnRenamed("job_id", "story_id")).withColumn("recent_stories", F.array_join("recent_stories", ",")), "SELECT f.family_id, " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in {**_PARTS, "stories": "attempts = 2"}.items()) + ", count(*) FILTER (status = 'failed') + count(*) FILTER (attempts = 4) AS review, any_value(r) AS recent_stories FROM jobs f LEFT JOIN (SELECT family_id, string_agg(job_id::VARCHAR, ',' ORDER BY created_at DESC, job_id) AS r FROM (SELECT * FROM jobs WHERE attempts = 2 QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY created_at DESC, job_id) <= 5) GROUP BY 1) s USING (family_id) GROUP BY f.family_id")
query("A29_corpus_registry", "documents", lambda d: R.corpus_registry(d.withColumn("lines", F.split("text", "\n")), "doc_id", {"raw_words": "text"}, {"timeline_nodes": "lines"}), r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\s\v\x{85}\p{Z}]+')), 0) AS raw_words, coalesce(len(string_split(text, chr(10))), 0) AS timeline_nodes FROM documents")
query("A30_plan_coverage", "customer", lambda c: R.plan_coverage(c, "c_nationkey", "c_mktsegment"), "SELECT c_nationkey, count(*) AS slots, count(DISTINCT c_mktsegment) AS anchors FROM customer GROUP BY 1")
query("A35_book_progress", "claims", lambda c: R.book_progress(c.select(F.col("recording_id").alias("book_id"), (F.col("claim_id") % 10).alias("number"), F.when(F.col("status") == "active", "approved").otherwise("draft").alias("status"), F.col("person_id").alias("words"), F.when(F.col("value") > "2", F.col("value")).alias("continuity"))), "SELECT recording_id AS book_id, count(*) AS chapters, count(*) FILTER (status = 'active') AS approved, sum(person_id)::BIGINT AS words, min(CASE WHEN status <> 'active' THEN claim_id % 10 END) AS next_chapter, arg_max(value, claim_id::VARCHAR || value) FILTER (value > '2') AS continuity FROM claims GROUP BY 1")
query("A37_acceptance_report", "claims claims", lambda c, i: R.acceptance_report(c.where("status = 'active'").select("object_type", F.col("claim_id").alias("object_id")), i.select("object_type", F.col("object_person_id").alias("object_id"), F.when(F.col("evidence_class") == "U", "error").otherwise("warning").alias("severity")), c.where("object_type = 'relationship'")), "SELECT a AS accepted, q AS quarantined, n AS candidates, r AS relationships, r / n AS acceptance_rate FROM (SELECT count(*) FILTER (status = 'active') AS a, count(DISTINCT claim_id) FILTER (status = 'active' AND object_type = 'relationship') AS r, count(*) FILTER (object_type = 'relationship') AS n, (SELECT count(*) FROM (SELECT DISTINCT object_type, object_person_id FROM claims WHERE evidence_class = 'U' AND object_person_id IS NOT NULL)) AS q FROM claims)")
query("A37_evidence_classes", "claims", R.evidence_classes, "SELECT evidence_class, count(*) AS n FROM claims GROUP BY 1")
_REL = lambda c: c.select("relationship_type", F.col("subject_person_id").alias("subject"), F.col("object_person_id").alias("object"))
query("A38_direction_accuracy", "claims", lambda c: R.direction_accuracy(_REL(c.where("claim_id % 2 = 0 AND object_person_id IS NOT NULL")), _REL(c.where("claim_id % 2 = 1 AND object_person_id IS NOT NULL"))), "SELECT count(*) FILTER (x) AS \"right\", count(*) AS asked, CASE WHEN count(*) = 0 THEN 1.0 ELSE count(*) FILTER (x) / count(*) END AS accuracy FROM (SELECT (t, s, o) IN (SELECT (relationship_type, subject_person_id, object_person_id) FROM claims WHERE claim_id % 2 = 1 AND object_person_id IS NOT NULL) AS x FROM (SELECT relationship_type AS t, subject_person_id AS s, object_person_id AS o FROM claims WHERE claim_id % 2 = 0 AND object_person_id IS NOT NULL) WHERE (t, least(s, o), greatest(s, o)) IN (SELECT (relationship_type, least(subject_person_id, object_person_id), greatest(subject_person_id, object_person_id)) FROM claims WHERE claim_id % 2 = 1 AND object_person_id IS NOT NULL))")
query("A38_label_accuracy", "predicted gold", lambda p, g: R.label_accuracy(p, g.dropDuplicates(["doc_id"]), "doc_id", "quality"), "SELECT count(*) FILTER (p.quality = g.quality) AS \"right\", count(*) AS asked, count(*) FILTER (p.quality = g.quality) / count(*) AS accuracy FROM gold g LEFT JOIN predicted p USING (doc_id)")
query("A38_scope_overlap", "predicted gold", lambda p, g: R.scope_overlap(p.where("quality = 1"), g.where("quality = 1"), "doc_id"), "SELECT count(*) FILTER (n = 2) AS common, count(*) AS either, count(*) FILTER (n = 2) / count(*) AS overlap FROM (SELECT doc_id, count(DISTINCT s) AS n FROM (SELECT doc_id, 1 AS s FROM predicted WHERE quality = 1 UNION ALL SELECT doc_id, 2 FROM gold WHERE quality = 1) GROUP BY 1)")
_CLASS = "CASE {0} % 4 WHEN 0 THEN 'normal' WHEN 1 THEN 'personal' WHEN 2 THEN 'sensitive' ELSE 'highly_sensitive' END AS sensitivity"
query("A40_sensitivity_recall", "claims orders", lambda c, o: R.sensitivity_recall(c.where("claim_id % 5 > 2").selectExpr("recording_id", _CLASS.format("person_id")), o.selectExpr("o_orderkey AS recording_id", _CLASS.format("o_custkey")), ["recording_id"]), "SELECT count(*) AS asked, count(*) FILTER (b >= r) AS met, count(*) FILTER (b < r) AS underclassified, count(*) FILTER (b >= r) / count(*) AS recall FROM (SELECT o_custkey % 4 AS r, b FROM orders LEFT JOIN (SELECT recording_id, max(person_id % 4) AS b FROM claims WHERE claim_id % 5 > 2 GROUP BY 1) ON recording_id = o_orderkey WHERE o_custkey % 4 > 0)")
query("W2_pad_ranges", "jobs", lambda j: R.padded_ranges(j.select("job_id", (F.col("size_bytes") % 900000).alias("start_sample"), (F.col("size_bytes") % 900000 + F.col("duration_seconds") * 1000).alias("end_sample")), 16000, F.lit(1_000_000)), "SELECT job_id, s + l AS start_sample, e - (x - l) AS end_sample FROM (SELECT *, x // 2 AS l FROM (SELECT *, CASE WHEN e - s > 398400 THEN e - s - 398400 ELSE 0 END AS x FROM (SELECT job_id, greatest(0, size_bytes % 900000 - 7200) AS s, least(1000000, size_bytes % 900000 + duration_seconds * 1000 + 7200) AS e FROM jobs)))")


def disagreeing(claims: DataFrame) -> DataFrame:
    return claims.groupBy(F.col("recording_id").alias("key")).agg(F.sort_array(F.collect_list("claim_id")).alias("claim_ids"))


query("W12_reopen_conflicts", "claims", lambda c: R.reopened_conflicts(disagreeing(c.where("recording_id % 5 > 0")), disagreeing(c.where("recording_id % 3 > 0 AND (recording_id % 4 > 0 OR claim_id % 10 > 1)")).select("key", "claim_ids", F.when(F.col("key") % 2 == 0, "resolved").otherwise("dismissed").alias("status"), F.when(F.col("key") % 2 == 0, F.col("claim_ids")[0] + F.when(F.col("key") % 8 == 2, 9).otherwise(0)).alias("preferred_claim_id"))).select("key", "status", "preferred_claim_id", "action", F.array_join(F.col("claim_ids").cast("array<string>"), ",").alias("claim_ids")), """SELECT key, CASE WHEN action = 'keep' THEN status ELSE 'open' END AS status, CASE WHEN action = 'keep' THEN p END AS preferred_claim_id, action, coalesce(array_to_string(n, ','), array_to_string(q, ',')) AS claim_ids
FROM (SELECT *, CASE WHEN n IS NULL THEN 'keep' WHEN status IS NULL THEN 'insert' WHEN n <> q OR (status = 'resolved' AND NOT list_contains(n, p)) THEN 'auto_reopen' ELSE 'keep' END AS action FROM (SELECT recording_id AS key, list(claim_id ORDER BY claim_id) AS n FROM claims WHERE recording_id % 5 > 0 GROUP BY 1)
FULL JOIN (SELECT recording_id AS key, list(claim_id ORDER BY claim_id) AS q, CASE WHEN recording_id % 2 = 0 THEN 'resolved' ELSE 'dismissed' END AS status, CASE WHEN recording_id % 2 = 0 THEN min(claim_id) + CASE WHEN recording_id % 8 = 2 THEN 9 ELSE 0 END END AS p FROM claims WHERE recording_id % 3 > 0 AND (recording_id % 4 > 0 OR claim_id % 10 > 1) GROUP BY 1) USING (key))""")


# Functions of the inventory that had no query.
def cited(claims: DataFrame) -> DataFrame:
    return claims.select("claim_id", "recording_id", F.array("evidence_id").alias("evidence_ids"))


def per_recording(claims: DataFrame) -> DataFrame:
    return claims.groupBy(F.col("recording_id").alias("conflict_id")).agg(F.sort_array(F.collect_set("claim_id")).alias("claim_ids"), F.max("claim_id").alias("preferred_claim_id"))


def judged(claims: DataFrame) -> DataFrame:
    status = F.when(F.col("conflict_id") % 3 == 0, "resolved").when(F.col("conflict_id") % 3 == 1, "dismissed").otherwise("open")
    return per_recording(claims.where("relationship_type = 'spouse'")).withColumn("status", status)


def canonical_edges(claims: DataFrame) -> DataFrame:
    return A.graph_edges(G.canonical_relationship(claims)).withColumn("edge_id", P.stable_id("edge", F.col("relationship_type"), F.col("subject_person_id"), F.col("object_person_id")))


query("K1_page_total", "jobs", lambda j: O.page_with_total(j.select("job_id", "created_at"), [F.desc("created_at"), F.asc("job_id")], 30, 60), "SELECT job_id, created_at, (SELECT count(*) FROM jobs) AS total FROM jobs ORDER BY created_at DESC, job_id LIMIT 30 OFFSET 60")
query("J2_resolve_mentions", "claims claims", lambda c, k: J.resolve_mentions(
    c.groupBy("recording_id").agg(F.sort_array(F.collect_set(F.col("claim_id") % 10), asc=False).alias("mention_ids")).withColumn("story_id", F.col("recording_id")),
    k.select("recording_id", (F.col("claim_id") % 10).alias("mention_id"), "person_id", "status"),
).select("recording_id", F.array_join("person_ids", ",").alias("persons")), """SELECT recording_id, string_agg(person_id::VARCHAR, ',' ORDER BY pos, person_id) AS persons FROM (SELECT DISTINCT recording_id FROM claims)
LEFT JOIN (SELECT recording_id, person_id, min(-(claim_id % 10)) AS pos FROM claims WHERE status = 'active' GROUP BY 1, 2) USING (recording_id) GROUP BY 1""")
query("J9_edge_support", "claims claims people", lambda c, k, p: J.edge_support(canonical_edges(c), G.canonical_relationship(k.where("status = 'active'")), p).select("relationship_type", "subject_person_id", "object_person_id", F.array_join("supporting_claim_ids", ",").alias("supporting")), f"""SELECT relationship_type, s AS subject_person_id, o AS object_person_id, string_agg(claim_id::VARCHAR, ',' ORDER BY claim_id) AS supporting FROM (SELECT DISTINCT * FROM ({_CANON} AND status = 'active'))
WHERE s IN (SELECT person_id FROM people) AND o IN (SELECT person_id FROM people) GROUP BY 1, 2, 3""")
query("J20_conflict_evidence", "claims claims evidence", lambda c, k, e: J.conflict_evidence(per_recording(c), cited(k), k.join(e, "evidence_id").select("recording_id", "evidence_id", F.col("quote").alias("text")).distinct()).select("conflict_id", "claim_id", F.array_join("quotes", "|").alias("quotes")), "SELECT recording_id AS conflict_id, claim_id, string_agg(quote, '|' ORDER BY evidence_id, quote) AS quotes FROM (SELECT DISTINCT recording_id, claim_id, evidence_id, quote FROM claims JOIN evidence USING (evidence_id)) GROUP BY 1, 2")
query("W13_apply_conflict_state", "claims claims", lambda c, k: O.apply_conflict_state(c.select("claim_id", "status"), judged(k)), """SELECT c.claim_id, CASE WHEN p IS NULL THEN status WHEN r % 3 = 1 THEN 'rejected' WHEN r % 3 = 2 THEN 'disputed' WHEN c.claim_id = p THEN 'accepted' ELSE 'rejected' END AS status
FROM claims c LEFT JOIN (SELECT claim_id, recording_id AS r, max(claim_id) OVER (PARTITION BY recording_id) AS p FROM (SELECT DISTINCT claim_id, recording_id FROM claims WHERE relationship_type = 'spouse')) USING (claim_id)""")
query("U1_union_typed", "claims usage_events reservations", lambda c, u, r: O.union_typed({"claim": c.select("claim_id", "status"), "usage": u.select("event_id", "model"), "reservation": r.select("reservation_id", "status")}), """SELECT claim_id, status, NULL::BIGINT AS event_id, NULL AS model, NULL::BIGINT AS reservation_id, 'claim' AS object_type FROM claims
UNION ALL SELECT NULL, NULL, event_id, model, NULL, 'usage' FROM usage_events UNION ALL SELECT NULL, status, NULL, NULL, reservation_id, 'reservation' FROM reservations""")
query("U3_id_difference", "refs objects", lambda r, o: O.id_difference(r, o, "storage_key"), """SELECT storage_key, 'missing' AS problem FROM (SELECT storage_key FROM refs EXCEPT SELECT storage_key FROM objects)
UNION ALL SELECT storage_key, 'unexpected' FROM (SELECT storage_key FROM objects EXCEPT SELECT storage_key FROM refs)""")
query("U4_merge_unique", "documents", lambda d: d.select("doc_id", F.array_join(O.merge_unique(F.array("lang", "source"), F.array(F.upper("source"), F.lit("x"), F.upper("lang"))), ",").alias("names")), """SELECT doc_id, array_to_string(list_filter([lang, CASE WHEN lower(source) <> lower(lang) THEN source END, CASE WHEN 'x' NOT IN (lower(lang), lower(source)) THEN 'x' END], lambda n: n IS NOT NULL), ',') AS names FROM documents""")
query("U5_set_relation", "claims", lambda c: c.groupBy("recording_id").agg(
    F.collect_list(F.when(F.col("relationship_type") != "spouse", F.col("object_person_id") % 5)).alias("a"), F.collect_list(F.when(F.col("relationship_type") != "sibling", F.col("object_person_id") % 5)).alias("b")
).select("recording_id", O.set_relation(F.col("a"), F.col("b")).alias("relation")), """SELECT recording_id, CASE WHEN both_ = na AND both_ = nb THEN 'equal' WHEN both_ = na THEN 'contained' WHEN both_ = nb THEN 'containing' WHEN both_ > 0 THEN 'overlapping' ELSE 'disjoint' END AS relation
FROM (SELECT recording_id, count(*) FILTER (a) AS na, count(*) FILTER (b) AS nb, count(*) FILTER (a AND b) AS both_ FROM (SELECT recording_id, x, bool_or(relationship_type <> 'spouse' AND x IS NOT NULL) AS a, bool_or(relationship_type <> 'sibling' AND x IS NOT NULL) AS b FROM (SELECT recording_id, relationship_type, object_person_id % 5 AS x FROM claims) GROUP BY 1, 2) GROUP BY 1)""")


def edited(part: DataFrame) -> DataFrame:
    return spread(part, "p_partkey").select("p_partkey", "p_brand", X.edit_counts(X.characters("p_name"), X.characters("p_type")).alias("e"))


query("T4_edit_counts", "part", lambda p: edited(p).select("p_partkey", F.col("e.n_reference").alias("n_reference"), (F.col("e.substitutions") + F.col("e.deletions") + F.col("e.insertions")).alias("errors")), "SELECT p_partkey, length(p_name)::BIGINT AS n_reference, levenshtein(p_name, p_type)::BIGINT AS errors FROM part")
query("A15_error_rate_report", "part", lambda p: A.error_rates(edited(p), "e", ["p_brand"]).select("p_brand", "n_pairs", "n_reference", "errors", F.round("rate", 9).alias("rate")), "SELECT p_brand, count(*) AS n_pairs, sum(length(p_name))::BIGINT AS n_reference, sum(levenshtein(p_name, p_type))::BIGINT AS errors, round(sum(levenshtein(p_name, p_type)) / greatest(sum(length(p_name)), 1), 9) AS rate FROM part GROUP BY 1")


def queries() -> dict[str, Query]:
    from ledgerspark.plans import archive, jobs  # noqa: F401  register their own

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from ledgerspark.plans import archive, jobs  # noqa: F401

    return dict(SQL)
