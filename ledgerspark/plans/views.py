"""Ledger-shaped tables derived from the given ones, each by one select that Spark
and other SQL engines read alike, so that a query and its SQL start from one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "TIMESTAMP '1998-06-01 00:00:00'"
NOW_EVENTS = "TIMESTAMP '2024-01-20 00:00:00'"

#: name: (source table, select list, condition)
VIEWS: dict[str, tuple[str, str, str]] = {
    "jobs": (
        "orders",
        """o_orderkey AS job_id, o_orderkey AS recording_id, o_custkey % 50 AS family_id, o_custkey AS user_id,
        CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE 'completed' END
          WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'transcribing' END AS status,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'waiting_for_asr' ELSE 'processing' END AS stage,
        o_orderkey % 5 AS attempts, 3 AS max_attempts, o_orderdate AS created_at, o_orderdate + INTERVAL 2 DAYS AS next_attempt_at,
        CASE WHEN o_orderstatus = 'P' THEN o_orderdate + INTERVAL 3 DAYS END AS lease_expires_at,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAYS END AS completed_at,
        o_orderstatus <> 'F' AS active, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, o_orderkey % 600 AS duration_seconds""",
        "TRUE",
    ),
    "recordings": ("orders", "o_orderkey AS recording_id, o_custkey AS user_id, o_orderdate AS created_at", "TRUE"),
    "results": ("lineitem", "l_orderkey AS recording_id, CAST(floor(l_quantity) AS BIGINT) AS n_people", "l_linenumber = 1"),
    "selected": ("orders", "o_orderkey AS recording_id", "o_orderpriority = '2-HIGH'"),
    "claims": (
        "lineitem",
        """l_orderkey * 10 + l_linenumber AS claim_id, l_orderkey AS recording_id, l_suppkey AS subject_person_id,
        CASE WHEN l_partkey % 20 = 0 THEN NULL ELSE l_partkey % 100 END AS object_person_id, l_suppkey AS person_id,
        CASE l_returnflag WHEN 'A' THEN 'parent_child' WHEN 'R' THEN 'spouse' ELSE 'sibling' END AS relationship_type,
        CASE WHEN l_linenumber % 2 = 0 THEN 'child' ELSE 'parent' END AS subject_role,
        CASE WHEN l_quantity < 10 THEN 'A' WHEN l_quantity < 25 THEN 'B' WHEN l_quantity < 40 THEN 'D' ELSE 'U' END AS evidence_class,
        CASE WHEN l_tax < 0.02 THEN 'former' WHEN l_tax < 0.03 THEN 'ended' ELSE 'current' END AS state, l_discount > 0.08 AS uncertain,
        CASE WHEN l_linestatus = 'F' THEN 'active' ELSE 'open' END AS status, CASE WHEN l_discount < 0.01 THEN 'rejected' ELSE 'unreviewed' END AS verification,
        CASE WHEN l_tax > 0.06 THEN 'reported' END AS assertion_mode,
        CASE l_linenumber WHEN 1 THEN 'person_mention' WHEN 2 THEN 'unresolved_question' ELSE 'relationship' END AS object_type,
        CASE WHEN l_returnflag = 'A' THEN 'birth_date' WHEN l_returnflag = 'R' THEN 'profession' ELSE 'alias' END AS predicate,
        CAST(l_partkey % 7 AS STRING) AS value, l_shipdate AS created_at, l_partkey AS evidence_id""",
        "TRUE",
    ),
    "people": ("supplier", "s_suppkey AS person_id, s_name AS canonical_name, s_nationkey AS nation", "TRUE"),
    "usage_events": (
        "events",
        """event_id, user_id, ts AS created_at, CASE event_type WHEN 'view' THEN ' Alpha' WHEN 'click' THEN 'beta' ELSE 'gamma' END AS provider, event_type AS model,
        CAST(floor(value * 10) AS BIGINT) AS input_tokens, CAST(floor(value * 3) AS BIGINT) AS cached_tokens, CAST(floor(value) AS BIGINT) AS output_tokens,
        event_type <> 'error' AS success, CAST(floor(value) AS DECIMAL(12,2)) AS cost, CAST(user_id % 3 AS BIGINT) AS audio_seconds""",
        "TRUE",
    ),
    "reservations": (
        "events",
        """event_id AS reservation_id, ts AS created_at, ts + INTERVAL 2 HOURS AS expires_at, CAST(floor(value) AS DECIMAL(12,2)) AS reserved_cost,
        CASE WHEN event_type = 'purchase' THEN CAST(floor(value / 2) AS DECIMAL(12,2)) END AS actual_cost,
        CASE event_type WHEN 'purchase' THEN 'committed' WHEN 'click' THEN 'reserved' WHEN 'view' THEN 'committed' ELSE 'released' END AS status""",
        "TRUE",
    ),
    "trace": ("events", "user_id AS job_id, event_type AS stage, event_id % 3 AS attempt, CAST(floor(value * 1000) AS BIGINT) AS duration_ms, ts AS created_at", "TRUE"),
    "decisions": ("events", "user_id AS conflict_id, event_type AS resulting_status, ts AS created_at, event_id", "TRUE"),
    "refs": ("orders", "CAST(o_orderkey AS STRING) AS storage_key, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes, CAST(o_custkey % 9 AS STRING) AS sha256", "o_orderkey % 7 <> 0"),
    "objects": (
        "orders",
        "CAST(o_orderkey AS STRING) AS storage_key, CAST(floor(o_totalprice) AS BIGINT) + o_orderkey % 3 AS size_bytes, CAST(o_custkey % 9 + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS STRING) AS sha256, o_orderdate AS modified_at",
        "o_orderkey % 5 <> 0",
    ),
    "evidence": (
        "part",
        """p_partkey AS evidence_id, CASE WHEN p_retailprice < 1100 THEN 'A' WHEN p_retailprice < 1400 THEN 'C' WHEN p_retailprice < 1700 THEN 'D' ELSE 'U' END AS evidence_class,
        'quote ' || p_name AS quote""",
        "p_size > 25",
    ),
    "predicted": ("documents", "doc_id, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END AS quality", "TRUE"),
    "gold": ("labels", "doc_id, CAST(quality AS INT) AS quality", "TRUE"),
    "remarks": (
        "lineitem",
        """l_orderkey * 10 + l_linenumber AS remark_id, l_orderkey AS recording_id, CASE l_partkey % 14 WHEN 0 THEN 'Он мне не не брат' WHEN 1 THEN 'Бывший муж'
        WHEN 2 THEN 'они развелись' WHEN 3 THEN 'не моя сестра' WHEN 4 THEN 'он мне как родной брат' WHEN 5 THEN 'неродной брат' WHEN 6 THEN 'Нет; точнее: Асан'
        WHEN 7 THEN 'Мать болела; больница; развод' WHEN 8 THEN 'самоубийство и суд' WHEN 9 THEN 'Алматы емес; Астана болуы керек' WHEN 10 THEN 'бұрынғы үй'
        WHEN 11 THEN 'не вдова; но небрат' WHEN 12 THEN NULL ELSE 'No; rather' END || CASE l_suppkey % 3 WHEN 0 THEN '; ағасы емес.' WHEN 1 THEN ' death' ELSE '' END AS text""",
        "TRUE",
    ),
    "surfaces": (
        "lineitem",
        """l_orderkey * 10 + l_linenumber AS mention_id, l_orderkey * 10 + l_linenumber AS position, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_suppkey % 7 + l_partkey END AS person_id,
        CASE WHEN l_linenumber % 2 = 0 THEN 'rec' ELSE 'Rec' END || CAST(l_orderkey % 40 AS STRING) AS recording_id, l_orderkey % 3 AS speaker_id,
        CASE l_linenumber % 3 WHEN 0 THEN 'Person  ' WHEN 1 THEN 'person-' ELSE 'person ' END || CAST(l_suppkey % 7 + l_partkey + CASE WHEN l_partkey % 11 = 0 THEN 1 ELSE 0 END AS STRING) AS name,
        CASE WHEN l_partkey % 5 = 0 THEN 'Al ' || CAST(l_partkey AS STRING) ELSE '' END AS alias, 'Al ' || CAST(l_suppkey * 7 AS STRING) AS variant,
        CASE WHEN l_quantity < 30 THEN 'unknown' WHEN l_quantity < 40 THEN 'family' ELSE 'friend' END AS category,
        CASE WHEN l_discount > 0.05 THEN 'rel ' || CAST(l_linenumber AS STRING) END AS relation, l_suppkey % 2 AS family_id""",
        "TRUE",
    ),
    "known_people": (
        "customer",
        """c_custkey AS person_id, 'Person ' || CAST(c_custkey AS STRING) AS canonical_name, 'al ' || CAST(c_custkey AS STRING) AS alias, 'AL ' || CAST(c_custkey + c_custkey % 2 * 4 AS STRING) AS verified,
        CASE WHEN c_custkey % 2 = 0 THEN 'unknown' ELSE 'neighbour' END AS category, 'kin' AS relation, c_custkey % 2 AS family_id""",
        "c_custkey % 3 <> 0",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a given one."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, columns, condition = VIEWS[name]
    base = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    return base.where(condition).selectExpr(*split_columns(columns))


def split_columns(columns: str) -> list[str]:
    """The items of a select list; commas in parentheses and strings don't part them."""
    out, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(columns):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and depth == 0 and not quoted:
            out.append(columns[start:i].strip())
            start = i + 1
    return [*out, columns[start:].strip()]


def with_views(sql: str, *names: str) -> str:
    """SQL that starts with the derived tables it names."""
    parts = [f"{n} AS (SELECT {VIEWS[n][1]} FROM {VIEWS[n][0]} WHERE {VIEWS[n][2]})" for n in names]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql
