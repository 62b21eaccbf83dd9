"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import bpe_stream, chat, decontaminate, fim_frames, html_text, jaccard_join, pii, quality, repair, secrets, token_files, toxicity, warc
from ledgerspark.llm.common import shared_dir, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pipeline_module():
    """The pipeline, which lies beside the package, from any working directory."""
    top = str(Path(__file__).resolve().parents[2])
    if top not in sys.path:
        sys.path.append(top)
    import corpus_pipeline

    return corpus_pipeline


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "share_distance", "kept")
    return quality.judge(docs).select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicate_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shards = token_files.write_token_files(docs, shared_dir(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_files.read_token_files(spark, shards).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = warc.write_warc(table(spark, sf_dir, "pages"), shared_dir(spark, "warc"))
    return warc.read_warc(spark, paths)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_stream.encode_digests(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "bpe.n_tokens", "bpe.ids_sha256", "bpe.decoded_sha256")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii.*")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], rows.schema)
    back = chat.read_back(chat.format_conversations(rows.unionByName(more)))
    line = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    learned = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan_benchmark(docs, table(spark, sf_dir, "benchmark"))
    hits = found.select("doc_id", F.col("scan.n_words").alias("n_words"), decontaminate.n_hit().alias("n_hit"), F.col("scan.items").alias("items"))
    return hits.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets.*")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages).select("page_id", "url", "main.text", "main.n_chars")


def op11_fim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = written(fim_frames.store_frames(docs), "fim-frames")
    made = fim_frames.digests(fim_frames.fill_in_middle(stored))
    return made.select(
        "doc_id",
        F.col("stored.n_units").alias("n"),
        "fim.form",
        F.col("fim.first").alias("prefix_chars"),
        (F.col("fim.second") - F.col("fim.first")).alias("middle_chars"),
        "digests.*",
    )


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (~toxicity.usable(F.col("doc_id"))).alias("held_out"), "toxicity.score", "toxicity.predicted",
        F.array_join(F.col("toxicity.evidence.doc_id").cast("array<string>"), ",").alias("evidence"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair.Repair(repair.damaged(rows)).report(rows)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_quality_rules, op2_ngram_jaccard_join, op3_token_files, op4_warc, op5_bpe, op6_pii, op7_chat_format, op8_decontaminate, op9_secrets, op10_html_text,
        op11_fim_frames, op12_toxicity, op13_conversation_repair,
    )
    return {f.__name__: f for f in own} | {"pipeline": pipeline_module().run}


_OP4 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

_OP7 = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '</turn>|### [A-Za-z0-9.*_+%-]*:')) AS controls FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(length(role) + 15 + length(text) + controls)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_OP8 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM bw), dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
), m AS (SELECT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP2 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d
), x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a AS id, a AS other FROM u UNION SELECT r.id, u.b FROM r JOIN u ON r.other = u.a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT id, min(other) AS component_id FROM r GROUP BY id) c ON c.id = s.doc_id
"""


_OP11 = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
), c AS (
  SELECT *, substring(t, 1, least(a, b)) AS p, substring(t, least(a, b) + 1, abs(a - b)) AS m, substring(t, greatest(a, b) + 1) AS s FROM u
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN least(a, b) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN abs(a - b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
"""


_ARROWS = {"s": {"0": 1}, "u": {"0": 2, "1": 2, "3": 2}, "a": {"2": 3}}


def _op13_state(s: int) -> str:
    """The cheapest way on from state s, over the row in ``i``: cost, audit, lines."""
    to = {0: 2, 1: 2, 2: 3, 3: 2}[s]
    role = "user" if to == 2 else "assistant"
    keep = " ".join(f"WHEN '{k}' THEN {v[str(s)]}" for k, v in _ARROWS.items() if str(s) in v)
    more = "CASE WHEN fault = 3 THEN 5 ELSE 0 END"
    arm = "{{'c': o[{to} + 1].c + {cost}, 'a': '{letter}' || o[{to} + 1].a, 't': {line}o[{to} + 1].t}}"
    kept = arm.format(to="k", cost=more, letter="K", line="[role || ':' || text] || ")
    moved = arm.format(to=to, cost=f"1 + {more}", letter="R", line=f"['{role}:' || text] || ")
    gone = arm.format(to=s, cost=2, letter="D", line="")
    return (
        f"list_min([{gone}] || CASE WHEN fault IN (1, 2) THEN [] ELSE [{moved}] END || "
        f"list_transform(list_filter([CASE initial {keep} END], lambda k: k IS NOT NULL AND fault NOT IN (1, 2)), lambda k: {kept}))"
    )


def _op13_inserts(v: str) -> str:
    """States v, once more with an insert first where that is less."""

    def one(s: int) -> str:
        to = {0: 2, 1: 2, 2: 3, 3: 2}[s]
        role = "user" if to == 2 else "assistant"
        there = f"{v}[{to + 1}]"
        return f"list_min([{v}[{s + 1}], {{'c': {there}.c + 5, 'a': 'I' || {there}.a, 't': ['{role}:'] || {there}.t}}])"

    return f"[{', '.join(map(one, range(4)))}]"


_OP13 = rf"""
WITH RECURSIVE k AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), z AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)),
    lambda h, b: list_reduce(list_prepend(xor(h, b), range(8)),
      lambda x, j: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS draw FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
    unnest(range(CASE draw WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM z
), o AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d)
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN nth > 1 THEN 2
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS bad FROM o
), n AS (
  SELECT conv_id, count(*) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (bad) AS illegal FROM f GROUP BY conv_id
), r AS (
  SELECT conv_id, n AS i, [{{'c': 0, 'a': '', 't': []::VARCHAR[]}}, {{'c': 10, 'a': 'II', 't': ['user:', 'assistant:']}},
    {{'c': 5, 'a': 'I', 't': ['assistant:']}}, {{'c': 0, 'a': '', 't': []::VARCHAR[]}}] AS o FROM n
  UNION ALL
  SELECT conv_id, i, {_op13_inserts("v1")} AS o FROM (
    SELECT conv_id, i, {_op13_inserts("v")} AS v1 FROM (
      SELECT r.conv_id, r.i - 1 AS i, [{", ".join(_op13_state(s) for s in range(4))}] AS v
      FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i)))
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(o[1].c, 0)::BIGINT AS cost,
  coalesce(o[1].a, '') AS audit, sha256(coalesce(array_to_string(o[1].t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = 0
"""


def oracle_sql() -> dict[str, str]:
    out = {"op2_ngram_jaccard_join": _OP2, "op4_warc": _OP4, "op7_chat_format": _OP7, "op8_decontaminate": _OP8, "op11_fim_frames": _OP11, "op13_conversation_repair": _OP13}
    whole = pipeline_module().ORACLE_SQL
    return out | ({"pipeline": whole} if whole else {})
