"""Fill-in-middle over frames against plain slicing."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerspark.llm import fim_frames as ff

ODD = [(1, None), (2, ""), (3, "x"), (4, "é😀" * 5000), (5, "a <P> b"), (6, "ends in <"), (7, "<S"), (7, "<S"), (None, "no id")]


def plain(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if n == 0 or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("units", [1, 3, 64, ff.FRAME_UNITS])
def test_rows(spark, units):
    docs = spark.createDataFrame([(i, t, "other") for i, t in ODD], "doc_id long, text string, fim string")
    stored = ff.store_frames(docs, frame_units=units)
    found = ff.digests(ff.fill_in_middle(stored, frame_units=units))
    text = ff.text_of(found)
    got = text.select("doc_id", F.col("stored.n_units"), "fim.form", "fim.first", F.col("fim.second") - F.col("fim.first"), "output.text", "digests.*").collect()
    want = [(i, *plain(i, t), sha(plain(i, t)[-1]), sha(t or "")) for i, t in ODD]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r[2] for r in got} >= {"plain", "psm"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ff.digests(ff.fill_in_middle(ff.store_frames(docs))).collect() == []


def test_only_cut_frames_are_opened():
    writer = ff.FrameWriter(100)
    writer.put("0123456789" * 1000)
    reader = ff.FrameReader(writer.close())
    assert "".join(reader.pieces(4990, 5010)) == "0123456789" * 2 and reader.opened == 2
    assert "".join(reader.pieces(5000, 5100)) == "0123456789" * 10 and reader.opened == 3
    assert list(reader.pieces(7, 7)) == [] and reader.opened == 3


@settings(max_examples=200, deadline=None)
@given(st.text("<PSM>ab", max_size=40), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["psm", "spm"]), st.integers(1, 7))
def test_any_text_comes_back(text, a, b, form, units):
    if ff.has_marks(text):
        return
    first, second = sorted((min(a, len(text)), min(b, len(text))))
    writer = ff.FrameWriter(units)
    writer.put(text)
    made = ff.arranged(writer.close(), form, first, second, units)
    assert "".join(ff.original(made, form)) == text
    assert all(f["n_units"] == units for f in made[:-1])
