"""Stars of sets that share boilerplate: links as by brute force, and rows in proportion."""

import random

import pytest

from ledgerspark.llm import jaccard_join
from tests.llm.test_llm import plain_components, plain_sets


def boilerplate(n, seed=1, shared=400, own=60):
    r = random.Random(seed)
    passage = [f"p{i}" for i in range(shared)]
    return [(i, " ".join(passage + [f"w{r.randrange(10**9)}" for _ in range(own)])) for i in range(n)]


@pytest.mark.parametrize(("seed", "percent", "few"), [(1, 90, 4), (3, 80, 6)])
def test_links_as_by_brute_force(spark, monkeypatch, seed, percent, few):
    """Passages of several levels, own parts on both sides of what a link allows, copies
    with edits among them, and sets next to the bare passage."""
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "SPLIT", 1)
    monkeypatch.setattr(jaccard_join, "LEVELS", 3)
    monkeypatch.setattr(jaccard_join, "CORE_SETS", 3 + seed)
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(10**6)}"
    top = [word() for _ in range(80)]
    groups = [[word() for _ in range(r.choice([10, 25]))] for _ in range(4)]
    rows = []
    for n in range(90):
        kind = r.random()
        text = top + (groups[n % 4] if kind < 0.7 else [])
        text = text + [word() for _ in range(r.choice([0, 1, 2, 4, 6, 9, 14]))]
        if rows and kind > 0.55:
            text = list(r.choice(rows)[1].split())
            for _ in range(r.choice([1, 1, 2, 3])):
                text[r.randrange(len(text))] = word()
        rows.append((n, " ".join(text)))
    want = plain_components(plain_sets(rows, 3), percent)
    got = jaccard_join.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=percent).collect()
    assert {x.doc_id: x.component_id for x in got} == want
    assert len(set(want.values())) > 3


def work(spark, monkeypatch, n):
    """Rows of cells and of residues that n texts make."""
    seen = []
    monkeypatch.setattr(jaccard_join, "SPLIT", 2)
    for name in ("possible_sets", "split_stars"):
        real = getattr(jaccard_join, name)

        def counted(rows, *args, real=real):
            seen.append(rows.count())
            return real(rows, *args)

        monkeypatch.setattr(jaccard_join, name, counted)
    docs = spark.createDataFrame(boilerplate(n), "doc_id long, text string")
    got = jaccard_join.near_duplicate_components(docs).collect()
    monkeypatch.undo()
    assert len(got) == n and all(r.component_id == r.doc_id for r in got)
    return sum(seen)


def test_rows_grow_in_proportion(spark, monkeypatch):
    small, large = work(spark, monkeypatch, 1500), work(spark, monkeypatch, 6000)
    assert 0 < small and large <= 5 * small and large <= 5 * 6000


def test_tasks_give_memory_back(monkeypatch):
    """Pipeline: a worker that lives on keeps nothing of a finished task."""
    from ledgerspark.llm import common

    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append(True))
    task = common.lean(lambda batches: iter([*batches, 3]))([1, 2])
    assert next(task) == 1 and not done
    assert list(task) == [2, 3] and done == [True]
