"""Streams fed by files give the rows that their static form gives; ranges and
budgets against plain versions."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerspark.functions import text as X
from ledgerspark.operators import ordering as O
from ledgerspark.plans import registry
from ledgerspark.plans.views import view
from ledgerspark.streaming import windows as S

SF = "/root/testdata/sf0.001"


def ran(stream, name, tmp_path):
    """All rows of a stream over the files there are."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return stream.sparkSession.table(name)


def source(spark, df, tmp_path):
    path = str(tmp_path / "in")
    df.repartition(2).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_duplicates_leave_a_stream(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("t", 1, k % 3, at + timedelta(minutes=k)) for k in range(9)] + [("u", 1, 0, at)]
    df = spark.createDataFrame(rows, "trace_id string, attempt int, sequence int, created_at timestamp")
    got = ran(S.trace_deduplicated(source(spark, df, tmp_path)), "dedupe", tmp_path)
    keys = ["trace_id", "attempt", "sequence"]
    assert sorted(map(tuple, got.select(keys).collect())) == sorted(map(tuple, S.trace_deduplicated(df).select(keys).collect())) == [("t", 1, 0), ("t", 1, 1), ("t", 1, 2), ("u", 1, 0)]


def test_rolling_usage_ends_with_the_watermark(spark, tmp_path):
    events = view(spark, SF, "usage_events").withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = {tuple(r) for r in ran(S.usage_rolling(source(spark, events, tmp_path)), "rolling", tmp_path).collect()}
    every = {tuple(r) for r in S.usage_rolling(events).collect()}
    last = events.agg(F.max("created_at")).first()[0] - timedelta(hours=1)
    assert got == {r for r in every if r[1] <= last} and got


def test_stage_pairs_stream(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("t", "asr", "start", at), ("t", "asr", "finish", at + timedelta(seconds=5)), ("t", "asr", "finish", at + timedelta(hours=3)), ("t", "nlp", "start", at)]
    df = spark.createDataFrame(rows, "trace_id string, stage string, phase string, created_at timestamp")
    assert [tuple(r) for r in ran(S.stage_pairs(source(spark, df, tmp_path)), "pairs", tmp_path).collect()] == [("t", "asr", at, 5000)]


def merged(ranges, max_len, max_gap):
    out = []
    for start, end in sorted(ranges):
        if out and end - out[-1][0] <= max_len and start - out[-1][1] <= max_gap:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(r) for r in out]


def test_merged_ranges(spark):
    rnd, rows = random.Random(3), []
    for key in range(40):
        for _ in range(rnd.randint(0, 30)):
            start = rnd.randint(0, 400) / 4
            rows.append((key, start, start + rnd.randint(0, 40) / 4))
    df = spark.createDataFrame(rows, "k int, start double, end double").repartition(5)
    want = sorted((k, *r) for k in range(40) for r in merged([(a, b) for i, a, b in rows if i == k], 22.0, 1.25))
    assert sorted(map(tuple, O.merged_ranges(df, "k", 22.0, 1.25).collect())) == want
    assert O.merged_ranges(df.limit(0), "k").count() == 0


def test_merged_ranges_of_all_traces(spark):
    ranges = view(spark, SF, "trace").selectExpr("job_id", "unix_micros(CAST(created_at AS timestamp)) / 1e6 AS s", "duration_ms / 1000 AS d").collect()
    by = {}
    for r in ranges:
        by.setdefault(r.job_id, []).append((r.s, r.s + r.d))
    want = sorted((k, *r) for k, v in by.items() for r in merged(v, 40000.0, 9000.0))
    assert sorted(map(tuple, registry.queries()["W1_merge_segments"](spark, SF).collect())) == want


def test_evidence_budget(spark):
    df = spark.createDataFrame([(1, k, k > 7) for k in range(10)] + [(2, k, True) for k in range(5)], "g int, id int, required boolean")
    got = {(r.g, r.id, r.over_budget) for r in O.evidence_budget(df, "g", 4, ["id"]).collect()}
    assert got == {(1, 8, False), (1, 9, False), (1, 0, False), (1, 1, False)} | {(2, k, True) for k in range(5)}


def test_text(spark):
    df = spark.createDataFrame([(1, "Straße №5 — ﬁne_x"), (2, None), (3, ""), (4, "Да. No! ok")], "id int, text string")
    assert [r[0] for r in df.orderBy("id").select(X.normalized("text")).collect()] == ["strasse no5 fine x", None, "", "да no ok"]
    assert [r[0] for r in df.orderBy("id").select(X.script("text")).collect()] == ["latin", None, "other", "mixed"]
    assert [r[0] for r in df.orderBy("id").select(X.shingles("text", 3)).collect()] == [["straße 5 fine_x".replace("fine", "ﬁne")], None, [], ["да no ok"]]
    assert [tuple(r) for r in X.statements(df, "id", "text").where("id = 4").collect()] == [(4, 0, "Да."), (4, 1, "No!"), (4, 2, "ok")]
