"""Every registered query against its SQL, and operators on small literal tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import aggregates as A
from ledgerspark.operators import graph as G
from ledgerspark.operators import joins as J
from ledgerspark.operators import ordering as O
from ledgerspark.operators import predicates as P
from ledgerspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = sorted(tuple(map(repr, r)) for r in df.select(*sorted(df.columns)).collect())
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(repr(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    assert got == want


def test_gazetteer_longest_first(spark):
    docs = spark.createDataFrame([(1, "Old Anna Maria Berg met Maria, Anna"), (2, None)], "doc_id long, text string")
    names = spark.createDataFrame([("Anna",), ("Anna Maria",), ("Maria Berg",), ("maria",)], "name string")
    got = sorted(tuple(r) for r in J.gazetteer_mentions(docs, names).collect())
    assert got == [(1, 2, 2, "anna maria"), (1, 6, 1, "maria"), (1, 7, 1, "anna")]


def test_gazetteer_chains(spark):
    """Chains of overlapping hits, against taking them greedily one by one."""
    r = random.Random(5)
    names = ["a b", "b c", "c d", "d e a", "e", "a a", "b b b", "a b c d e a b", "c c c c c"]
    texts = ["a b c d", "a b c d e a b", "a b " * 20, "a " * 31, "b " * 17, "c " * 14, "d e a b c d"] + [" ".join(r.choice("abcde") for _ in range(r.randrange(1, 60))) for _ in range(60)]

    def greedy(text):
        w, taken = text.split(), []
        found = [(i, len(x.split()), x) for x in names for i in range(len(w)) if w[i : i + len(x.split())] == x.split()]
        for i, n, x in sorted(found, key=lambda h: (-h[1], h[0])):
            if all(i + n <= j or j + m <= i for j, m, _ in taken):
                taken.append((i, n, x))
        return [(i + 1, n, x) for i, n, x in taken]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(x) for x in J.gazetteer_mentions(docs, spark.createDataFrame([(x,) for x in [*names, None]], "name string")).collect())
    assert got == sorted((i, *h) for i, t in enumerate(texts) for h in greedy(t))
    assert (0, 1, 2, "a b") in got and (0, 3, 2, "c d") in got and (1, 1, 7, "a b c d e a b") in got


def test_siblings_of_all_claims(spark):
    """Every claim counts, whatever its number."""
    claims = registry.view(spark, SF, "claims").where("object_person_id IS NOT NULL").collect()
    children, want = {}, set()
    for c in claims:
        if c.relationship_type == "sibling":
            want |= {(c.subject_person_id, c.object_person_id), (c.object_person_id, c.subject_person_id)}
        elif c.relationship_type == "parent_child":
            children.setdefault(c.subject_person_id, set()).add(c.object_person_id)
    want |= {(a, b) for x in children.values() for a in x for b in x}
    got = [tuple(x) for x in registry.queries()["J11_all_shared_parent_siblings"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if a != b}
    part = {tuple(x) for x in registry.queries()["J11_shared_parent_siblings"](spark, SF).collect()}
    assert part == set(got)


def test_weakest_class_falls_back(spark):
    """Objects without known evidence keep their own class, and it counts for the others."""
    o = spark.createDataFrame([(1, [1, 2], "A"), (2, [9], "C"), (3, [], "B"), (4, [1], "D"), (5, [3], "A")], "object_id long, evidence_ids array<long>, fallback_class string")
    e = spark.createDataFrame([(1, "A"), (2, "D"), (3, "U")], "evidence_id long, evidence_class string")
    assert {r.object_id: r.evidence_class for r in A.weakest_class(o, e).collect()} == {1: "D", 2: "C", 3: "B", 4: "D", 5: "U"}


def test_antecedents(spark):
    a = spark.createDataFrame([(1, 2, 50, 100, 100, "x", None), (1, 3, 5, 300, 200, "y", None), (1, 4, 0, 10, 10, "z", None)], "doc_id long, unit int, pos int, unit_chars int, prev_chars int, anaphor_id string, quote string")
    m = spark.createDataFrame([(1, 2, 10, "m1", None), (1, 2, 60, "m2", None), (1, 3, 1, "m3", None), (1, 3, 2, "m4", None)], "doc_id long, unit int, pos int, mention_id string, quote string")
    got = {r.anaphor_id: (r.candidates, r.status) for r in J.nearest_antecedent(a, m).collect()}
    assert got == {"x": (["m1"], "resolved"), "y": (["m3", "m4"], "ambiguous"), "z": (["m3", "m4"], "ambiguous")}


def test_mentions_and_people(spark):
    s = spark.createDataFrame([(1, "a", ["m2", "m1", "m2", "m9"]), (1, "b", [])], "recording_id long, story_id string, mention_ids array<string>")
    c = spark.createDataFrame([(1, "m1", "p1", "active"), (1, "m2", "p2", "active"), (1, "m9", "p9", "open")], "recording_id long, mention_id string, person_id string, status string")
    got = {r.story_id: r.person_ids for r in J.resolve_mentions(s, c).collect()}
    assert got == {"a": ["p2", "p1"], "b": None}
    people = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "person_id string")
    t = spark.createDataFrame([("a", ["p3", "x", "p1", "p2"]), ("b", [])], "story_id string, person_ids array<string>")
    assert {r.story_id: (r.shown, r.hidden) for r in P.story_people(t, people, 2).collect()} == {"a": (["p3", "p1"], 1), "b": ([], 0)}


def test_masks(spark):
    df = spark.createDataFrame([({"Auth_Token": "x", "input_tokens": "3", "note": "Bearer abc.def", " K ": "1", "k": "2"},)], "m map<string,string>")
    assert P.redact_map(df, "m").first().m == {"Auth_Token": "[redacted]", "input_tokens": "3", "note": "Bearer [redacted]", " K ": "1", "k": "2"}
    df = df.select(F.create_map(*[F.lit(x) for x in ("Auth_Token", "x", "input_tokens", "3", "note", "Bearer abc.def", " K ", "1", "k", "2", "", "y")]).alias("m"))
    assert P.trace_attributes(df, "m").first().m == {"input_tokens": "3", "note": "Bearer abc.def", "k": "2"}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9)], "a long, b long")
    assert {(r.id, r.component) for r in G.connected_components(e).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (9, 9)}
    kin = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 8), (8, 7)], "parent long, child long")
    people = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 7, 8)], "person_id long")
    got = {r.person_id: (r.depth, r.on_cycle) for r in G.generation_depth(kin, people, most=6).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [(0, False), (1, False), (2, False), (0, False)] and got[7][1]
    rel = spark.createDataFrame([("parent_child", 1, 2), ("parent_child", 1, 3), ("spouse", 1, 5)], "relationship_type string, subject_person_id long, object_person_id long")
    got = {r.person_id: r for r in G.family_relations(rel, people).collect()}
    assert got[1].children == [2, 3] and got[1].spouse_id == 5 and got[2].siblings == [3] and got[4].parents is None


def test_conflicts_and_retries(spark):
    claims = spark.createDataFrame([(i, "active") for i in range(1, 8)], "claim_id long, status string")
    conflicts = spark.createDataFrame([(1, "resolved", [1, 2], 1), (2, "dismissed", [3], None), (3, "open", [4, 5], None)], "conflict_id long, status string, claim_ids array<long>, preferred_claim_id long")
    got = {r.claim_id: r.status for r in O.apply_conflict_state(claims, conflicts).collect()}
    assert got == {1: "accepted", 2: "rejected", 3: "rejected", 4: "disputed", 5: "disputed", 6: "active", 7: "active"}
    f = spark.createDataFrame([("slow", 1, None), ("slow", 20, None), ("slow", 2, 0.1), ("odd", 1, None)], "error_code string, attempt int, retry_after double")
    rules = spark.createDataFrame([("slow", "timeout", "retry")], "error_code string, category string, disposition string")
    assert [r.delay_seconds for r in P.retry_schedule(f, rules).orderBy("attempt", "error_code").collect()] == [None, 2.0, 0.5, 300.0]


def test_names_and_dates(spark):
    row = spark.createDataFrame([(["Ann", "BOB"], ["bob", "Cy", "ann"])], "a array<string>, b array<string>")
    assert row.select(O.merge_unique(F.col("a"), F.col("b"))).first()[0] == ["Ann", "BOB", "Cy"]
    d = spark.createDataFrame([(None, "1961", None, None), ("1961-05", "May", "month", True)], "normalized_value string, value string, precision string, approximate boolean")
    assert [tuple(r)[4:] for r in P.date_view(d).collect()] == [("1961", "unknown", False), ("1961-05", "month", True)]


def test_empty_inputs(spark):
    jobs = spark.createDataFrame([], "status string, created_at timestamp, lease_expires_at timestamp")
    assert tuple(A.queue_health(jobs, F.expr("TIMESTAMP '2024-01-01 00:00:00'")).first()) == (0, 0, 0, 0, None, 0)
    none = spark.createDataFrame([], "k long")
    assert tuple(A.set_prf(none, none, ["k"]).first()) == (0, 0, 0, 1.0, 1.0, 1.0)


def test_edit_counts(spark):
    """Against a plain table of (distance, substitutions, deletions, insertions)."""
    from ledgerspark.functions import text as X

    def plain(a, b):
        best = {(0, 0): (0, 0, 0, 0)}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                ways = []
                if i and j:
                    d, s, e, n = best[i - 1, j - 1]
                    ways.append((d, s, e, n) if a[i - 1] == b[j - 1] else (d + 1, s + 1, e, n))
                if i:
                    d, s, e, n = best[i - 1, j]
                    ways.append((d + 1, s, e + 1, n))
                if j:
                    d, s, e, n = best[i, j - 1]
                    ways.append((d + 1, s, e, n + 1))
                best[i, j] = min(ways, default=(0, 0, 0, 0))
        return best[len(a), len(b)][1:]

    r = random.Random(8)
    pairs = [("".join(r.choice("abc") for _ in range(r.randrange(9))), "".join(r.choice("abcd") for _ in range(r.randrange(9)))) for _ in range(300)]
    pairs += [("", ""), ("a", ""), ("", "ab"), (None, "a"), ("kitten", "sitting"), ("я и он", "я  ион")]
    df = spark.createDataFrame(list(enumerate(pairs)), "i long, p struct<a:string,b:string>")
    got = df.select("i", X.edit_counts(X.characters("p.a"), X.characters("p.b")).alias("e"))
    for row in got.collect():
        a, b = pairs[row.i]
        want = (None,) * 4 if a is None else (len(a), *plain(a, b))
        assert tuple(row.e) == want if row.e is not None else a is None, (a, b)
    total = A.error_rates(got, "e").first()
    assert total.n_pairs == len(pairs) and total.rate == total.errors / total.n_reference
