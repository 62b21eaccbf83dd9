"""Round trips of sources and sinks in a folder of their own."""

from ledgerspark.sources import ledger as L


def test_corpus_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/b.json").write_text('{\n "sample_id": "s1",\n "n": 1}')
    (tmp_path / "in/a.json").write_text('{"sample_id": "s2", "n": null}')
    (tmp_path / "in/c.txt").write_text("no sample")
    df = L.read_corpus(spark, str(tmp_path / "in"), "sample_id string, n long")
    assert sorted(tuple(r) for r in df.collect()) == [("s1", 1, "b.json"), ("s2", None, "a.json")]
    L.write_corpus(df, str(tmp_path / "out"))
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ['{"sample_id":"s1","n":1,"file_name":"b.json"}', '{"sample_id":"s2","n":null,"file_name":"a.json"}']
    L.write_plan(df, str(tmp_path / "plan"))
    assert spark.read.option("header", True).csv(str(tmp_path / "plan")).count() == 2


def test_objects_and_export(spark, tmp_path):
    (tmp_path / "x/y").mkdir(parents=True)
    (tmp_path / "x/y/one.bin").write_bytes(b"12345")
    got = L.read_objects(spark, str(tmp_path / "x")).collect()
    assert [(r.storage_key.endswith("x/y/one.bin"), r.size_bytes) for r in got] == [(True, 5)]
    t = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "family_id long, name string")
    L.write_family_export({"people": t}, str(tmp_path / "export"))
    got = L.family_export(spark, str(tmp_path / "export"), "people", 1).collect()
    assert sorted(r.name for r in got) == ["a", "b"]
