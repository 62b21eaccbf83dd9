"""Toxicity scores: exact neighbours, held-out accuracy, odd rows."""

import math
import zlib

import numpy as np
import pytest

from ledgerspark.llm import toxicity as tx

SF = "/root/testdata/sf0.1"


def random_vectors(rng, n, terms):
    out = []
    for _ in range(n):
        ids = np.sort(rng.choice(terms - 1, rng.integers(0, 5), replace=False))
        ids = np.append(ids, terms - 1)
        w = rng.integers(1, 4, len(ids)).astype(float)
        out.append((ids, w / math.sqrt(w @ w)))
    return out


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_index_is_exact(n):
    rng = np.random.default_rng(n)
    vectors = random_vectors(rng, n, 30)
    vectors.sort(key=lambda v: (int(v[0][np.argmax(v[1])]), -v[1].max()))
    index = tx.BlockMaxIndex(vectors, 30, block=16)
    dense = np.zeros((n, 30))
    for k, (t, w) in enumerate(vectors):
        dense[k, t] = w
    for terms, weights in random_vectors(rng, 60, 30):
        skip = int(rng.integers(n)) if n else -1
        cosines = np.round(dense[:, terms] @ weights, 12)
        want = sorted((-c, v) for v, c in enumerate(cosines) if v != skip)[:15]
        got = index.nearest(terms, weights, 15, skip)
        assert [c for c, _ in got] == pytest.approx([-c for c, _ in want], abs=1e-11)
        assert len(want) < 15 or {v for c, v in got if c > -want[-1][0] + 1e-11} == {v for c, v in want if -c > -want[-1][0] + 1e-11}
    if n > 100:
        assert index.visited < 61 * index.blocks
    for v in range(0, n, 37):
        terms, weights = tx._row(index, v)
        assert terms.tolist() == vectors[v][0].tolist() and weights.tolist() == vectors[v][1].tolist()


def test_calibration_never_falls():
    votes, shares = tx.calibrated([(0.0, 0, 50), (0.1, 2, 4), (0.2, 1, 4), (0.9, 9, 10)])
    assert (np.diff(shares) >= 0).all() and (np.diff(votes) > 0).all() and len(votes) == 3


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = tx.fit(docs, labels)
    assert model.counts.sum() <= tx.MAX_EXAMPLES
    found = tx.score(docs.join(labels.select("doc_id", "toxic"), "doc_id").where(~tx.usable(docs.doc_id)), model)
    rows = [(r.toxicity.score, r.toxicity.predicted, r.toxic) for r in found.select("toxicity", "toxic").collect()]
    hit, wrong = sum(p and t for _, p, t in rows), sum(p and not t for _, p, t in rows)
    toxic = sum(t for _, _, t in rows)
    assert len(rows) > 800 and hit > 0.9 * toxic and wrong < 0.01 * len(rows)
    assert np.mean([(s - t) ** 2 for s, _, t in rows]) < 0.02


def small(spark):
    texts = {i: ("vile rotten scum " if i % 3 == 0 else "") + f"plain words here number{i % 7} and more" for i in range(600)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    rows = [(i, int(i % 3 == 0), 5) for i in texts] + [(None, 1, 0), (1, None, 0), (0, 1, 0), (10**9, 1, 1)]
    return docs, spark.createDataFrame(rows, "doc_id long, toxic int, quality int")


def test_labels_held_out_are_not_learnt(spark):
    docs, labels = small(spark)
    flipped = [(r.doc_id, 1 - r.toxic, r.quality) if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2 else tuple(r) for r in labels.collect()]
    a, b = tx.fit(docs, labels), tx.fit(docs, spark.createDataFrame(flipped, labels.schema))
    assert a.terms.ids == b.terms.ids and a.toxic.tolist() == b.toxic.tolist() and a.shares.tolist() == b.shares.tolist()


def test_odd_rows(spark):
    docs, labels = small(spark)
    model = tx.fit(docs, labels)
    odd = [(1, None, 7), (1, "", 7), (2, "rotten scum", 7), (2, "rotten scum", 7), (None, "plain words here", 7), (3, "calm " * 200000 + "vile rotten scum", 7), (4, "\x00 \U0001f600", 7)]
    found = tx.score(spark.createDataFrame(odd, "doc_id long, text string, toxicity int"), model).collect()
    got = [(r.doc_id, r.text, r.toxicity.score, r.toxicity.predicted) for r in found]
    assert len(got) == 7 and all(0 <= s <= 1 for _, _, s, _ in got)
    by = {t if t is None else t[:11]: (s, p) for _, t, s, p in got}
    assert by["rotten scum"][1] == 1 and by[None] == by[""] and by[""][1] == 0 and by["plain words"][1] == 0
    assert all(e.cosine <= 1.0 + 1e-9 and 0 <= e.toxic_share <= 1 for r in found for e in r.toxicity.evidence)
    assert tx.score(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_no_labels(spark):
    docs, labels = small(spark)
    for none in (labels.limit(0), labels.where("toxic = 1")):
        model = tx.fit(docs, none)
        rows = tx.score(docs.limit(5), model).select("toxicity.*").collect()
        assert [(r.score, r.predicted, r.evidence) for r in rows] == [(0.0, 0, [])] * 5
