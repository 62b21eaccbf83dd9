"""Steps whose cost or result once changed with the size of the tables."""

import random
import re
import time
import unicodedata

from pyspark.sql import functions as F

from ledgerspark.functions import claims as K
from ledgerspark.functions import evidence as E
from ledgerspark.functions import lexicon as L
from ledgerspark.functions import text as X
from ledgerspark.operators import graph as G
from ledgerspark.operators import joins as J
from ledgerspark.operators.people import mention_candidates
from ledgerspark.operators.resolution import AGAINST, SUPPORT, _names, candidate_states
from ledgerspark.plans import archive, registry


def test_word_offsets_by_bounded_steps(spark):
    """two numbers a word, in batches that are bounded by code points."""
    texts = [(1, "ab c"), (2, None), (3, ""), (4, "é 𝒳x yy " * 50), (5, "z")]
    docs = spark.createDataFrame(texts, "id long, text string").coalesce(1)
    for step in (1, 10, 10**6):
        got = {r.id: r.words and [tuple(w) for w in r.words] for r in E.word_offsets(docs, "text", step=step).collect()}
        assert got == {i: (None if t is None else [m.span() for m in re.finditer(r"\w+", t)] or got[i]) for i, t in texts}
        assert got[3] == []


def test_shingles_of_a_long_text(spark):
    """words are found once a text, not once a shingle."""
    df = spark.range(1).select(F.expr("array_join(transform(sequence(1, 30000), i -> concat('w', i)), ' ')").alias("text"))
    start = time.time()
    assert df.select(F.size(X.shingles("text", 5))).first()[0] == 29996
    assert time.time() - start < 15


def test_offsets_where_ids_are_far_apart(spark):
    """an unknown segment stays unknown, and rows that share an id keep their texts."""
    rows = [(13, "a b c"), (13 + 10**12, "a b d"), (7, "x y z"), (7, "x y w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.evidence_id, r.found, r.start_char) for r in E.recovered_offsets(*registry.spans_of(docs)).collect())
    known = [(7, "recovered", 4)] * 2
    assert got == known + [(13, "unknown_segment", 0), (13 + 10**12, "recovered" if (13 + 10**12) % 13 else "unknown_segment", 4 if (13 + 10**12) % 13 else 0)]


def test_sensitivity_makes_the_normal_form_once(spark):
    """not once for every marker."""
    df = spark.createDataFrame([("его больница, ажырасты; рак",), ("суицид суд",), ("hospitals",), (None,)], "text string").select(L.sensitivity("text").alias("s"))
    assert [(r.s.level, r.s.categories) for r in df.collect()] == [("sensitive", ["family_conflict", "health_or_death"]), ("highly_sensitive", ["violence_or_self_harm"]), ("normal", []), ("normal", [])]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_rows_are_spread_before_long_work(spark):
    """one row group isn't one task, and a text is lowered once for all markers."""
    df = registry.queries()["T16_uncertainty"](spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression" in df._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.createDataFrame([("Асан, кажется, уехал; болуы мүмкін",), ("нет",), (None,)], "text string")
    found = rows.select(K.uncertainty_markers("text", F.array().cast("array<struct<start:int,end:int>>")).alias("m"))
    assert [r.m and [m.surface for m in r.m] for r in found.collect()] == [["кажется", "болуы мүмкін", "мүмкін"], [], None]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(text") == 1


def test_dates_are_read_once(spark):
    """a text is trimmed, and a date read, once for all rules."""
    rows = spark.createDataFrame([("около 1950", "1950")], "e string, v string")
    checks = rows.select(F.array_join(K.date_checks("e", F.lit("exact_date"), F.lit("year"), F.lit(False), "v", "e", F.lit(None).cast("string")), ",").alias("x"))
    assert checks.first().x == "silently_exactified,temporal_precision_overstated"
    assert checks._jdf.queryExecution().optimizedPlan().toString().count("(?U)\\A\\s+") == 1


def test_support_reads_words_in_python_once(spark):
    """endings are stripped once a word, and only open pairs are given to the order test."""
    L._stems.cache_clear()
    assert [L.support(["брата", "видел"], ["видели", "братом"]) for _ in range(50)] == ["role_order_changed"] * 50
    assert L._stems.cache_info().misses <= 4
    rows = spark.createDataFrame([("a б", "я a б"), ("", "a"), (None, None), ("мать болела", "мать не болела"), ("x 5", "5 x")], "s string, e string")
    assert [r[0] for r in rows.select(L.factual_support("s", "e")).collect()] == ["exact", "unsupported", "unsupported", "drops_negation", "ordered"]


def test_quarantine_stages_join_what_they_read_once(spark):
    """what fell at earlier stages isn't joined again at each later one."""
    from ledgerspark.operators import quarantine as Q

    text = '{"people_mentions":[{"mention_id":"m1","name":"A","confidence":1}],"stories":[{"story_id":"t1","title":"t","summary":"s","event_ids":["v0"],"privacy":"private"}]}'
    judged = Q.judged_items(spark.createDataFrame([("r", text)], "recording_id string, extraction string"))
    assert sorted((r.kind, r.outcome) for r in judged.collect()) == [("person", "valid"), ("story", "object_reference_invalid")]
    assert len(re.findall(r"(?m)^[:+\- ]*Join ", judged._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_windows_of_many_segments():
    """windows become one without summing all others again."""
    from ledgerspark.operators import transcripts as W

    n = 30000
    start = time.time()
    windows = W.packed(list(range(n)), [i * 1.0 for i in range(n)], [i + 0.9 for i in range(n)], [i % 7 + 300 for i in range(n)], ["x"] * n)
    assert len(windows) == 6 and sorted({i for w in windows for i in w}) == list(range(n))
    assert time.time() - start < 10


def test_edit_paths_of_many_pairs():
    """pairs share arrays; one at a time the 20,000 pairs of sf0.1 took 2.33 s, together 0.22 s."""
    r = random.Random(5)
    word = lambda most: [r.choice("abcd") for _ in range(r.randrange(most))]
    pairs = [(word(12), word(12)) for _ in range(500)] + [([], []), (list("ab"), []), ([], list("ab")), (word(40), word(3))]
    assert X.edit_paths(pairs) == [X.edit_path(*p) for p in pairs] and X.edit_paths([]) == []
    many = [([r.choice("abcdefgh") for _ in range(33)], [r.choice("abcdefgh") for _ in range(20)]) for _ in range(20_000)]
    start = time.process_time()
    X.edit_paths(many)
    assert time.process_time() - start < 1.5


def test_composed_texts_stay_out_of_python(spark):
    """what NFC leaves alone by its characters alone isn't sent to Python."""
    plain = [chr(c) for c in range(0x530) if re.match(f"[{E.COMPOSED}]", chr(c))]
    assert all(unicodedata.is_normalized("NFC", a + c) and not unicodedata.combining(c) for a in "aи" for c in [*plain, "…", "—", "№"])
    said = ["Cafe\u0301  \u0438\u0306", "\u0401\u00e9 a", "\u1112\u1161\u11ab", "\u212b", None, ""]
    df = spark.createDataFrame([(s,) for s in said], "t string")
    assert [x[0] for x in df.select(E.spaced("t")).collect()] == ["Caf\u00e9 \u0439", "\u0401\u00e9 a", "\ud55c", "\u00c5", None, ""]
    assert [x[0] for x in df.select(F.col("t").rlike(f"[^{E.COMPOSED}]")).collect()] == [True, False, True, True, None, False]


def test_parts_of_a_long_text(spark):
    """the words of a text are found once, not once for each of its parts."""
    words = [f"w{i}" for i in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, None)], "doc_id long, text string")
    start = time.monotonic()
    got = {(r.doc_id, r["index"]): r.text for r in archive.overlapping_parts(docs).collect()}
    assert time.monotonic() - start < 15
    assert len(got) == 3002 and got[1, 7] == " ".join(words[140:164]) and got[2, 0] == "" and got[3, 0] is None


def test_mention_candidates_read_each_side_once(spark):
    """A mention's name, aliases and variants come from one pass over the
    mentions, as do a person's."""
    mentions = spark.createDataFrame([(0, 1, "Ann-Lee", ["Al", "al"], ["ANN LEE"])], "family_id long, mention_id long, name string, aliases array<string>, variants array<string>")
    people = spark.createDataFrame([(0, 7, "ann lee", ["annlee"], ["AL"])], "family_id long, person_id long, canonical_name string, aliases array<string>, verified_aliases array<string>")
    found = mention_candidates(mentions, people)
    assert sorted(map(tuple, found.collect())) == [(1, 7, "name_alias"), (1, 7, "name_canonical"), (1, 7, "variant_canonical")]
    assert found._jdf.queryExecution().sparkPlan().toString().count("Scan ExistingRDD") == 2


def test_resolution_judges_rows_that_repeat_an_id(spark):
    """the names of both rows nominate, and each row is a candidate's own judgement."""
    mentions = spark.createDataFrame(
        [(0, 1, "Ann", [], [], "son", "family_member", "stated", None), (0, 1, "nobody", [], [], "father", "family_member", "stated", None)],
        "family_id long, mention_id long, name string, aliases array<string>, variants array<string>, relation string, category string, assertion_mode string, uncertainty string",
    )
    profiles = spark.createDataFrame(
        [(0, 7, "ann", [], [], "son", 1, "family_member")],
        "family_id long, person_id long, canonical_name string, aliases array<string>, verified_aliases array<string>, relation string, generation int, category string",
    )
    states = candidate_states(mentions, profiles)
    assert sorted(map(tuple, states.select("mention_id", "person_id", _names(SUPPORT, "supporting"), _names(AGAINST, "conflicting")).collect())) == [
        (1, 7, ["category", "generation", "name_canonical", "relation"], []),
        (1, 7, ["category", "name_canonical"], ["generation_conflict", "relation_conflict"]),
    ]
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(person_id") == 0


def test_stars_leave_no_edges_for_rounds(spark):
    """leaves take their hub's name at once; only edges between names go through rounds."""
    stars = [(hub, 1000 * (hub + 1) + leaf) for hub in range(3) for leaf in range(300)]
    names, left = G.contracted(spark.createDataFrame(stars, "a long, b long"))
    assert left.count() == 0 and names.count() == 903
    rng = random.Random(24)
    for n_edges in (0, 60):
        pairs = [(rng.randrange(100), rng.randrange(100)) for _ in range(n_edges)] + [(7, None), (None, None), (300, 300)]
        pairs += [(i, i + 1) for i in range(400, 440)] + [(599, i) for i in range(500, 540)]
        of = {i: i for i in [*range(95, 105), *[x for p in pairs if None not in p for x in p]]}
        for _ in of:
            for a, b in pairs:
                if a is not None and b is not None:
                    of[a] = of[b] = min(of[a], of[b])
        people = spark.createDataFrame([(i,) for i in [*range(95, 105), None, 95]], "id long")
        got = [tuple(r) for r in G.connected_components(spark.createDataFrame(pairs, "a long, b long"), people=people).collect()]
        assert len(got) == len(of) and dict(got) == of


def test_near_duplicates_read_texts_once(spark):
    """grams are made once, not by every reader of the sets."""
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words).upper(), " ".join([*words[:30], *["x"] * 10]), " ".join(words[:7]), None, "other " * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = J.near_duplicates(docs)
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()
    shared, joint = 23, 33 + 31 - 23  # of the third text 30 - 7 runs are the first's, 7 meet the x and one is of x alone
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1.0), (0, 2, shared / joint)]


def test_objects_are_matched_from_rows_read_once(spark):
    """lines are gathered once, Python gets only labels beyond ASCII, and both sides meet
    in one grouping, where null cases and kinds still equal nothing."""
    plan = registry.queries()["A39_semantic_match"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FileScan" not in plan and "parquet" not in plan and "FullOuter" not in plan
    lines = [(1, 5, 7, 1), (1, 4, 7, 1), (1, None, 3, 1), (1, -3, 2, 2), (1, -3, None, 2), (None, 1, 1, 3)]
    found = archive.matched_objects(spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"))
    assert {(r.case_id, r.kind): (r.tp, r.fp, r.fn, r.participants_right, r.participants_of) for r in found.collect()} == {
        (1, "story"): (0, 1, 1, None, None), (1, "description"): (0, 1, 1, None, None), (None, "event"): (0, 1, 1, None, None),
    }
    texts = [("Straße-№5",), ("A  b!",), (None,), ("",)]
    got = X.with_normalized(spark.createDataFrame(texts, "t string"), "t").collect()
    assert sorted([r.t for r in got], key=str) == ["", None, "a b", "strasse no5"]


def test_windows_of_many_transcripts(spark):
    """transcripts stream through a task; each as a data frame took 10 ms, so 20,000 took 200 s of tasks."""
    from ledgerspark.operators import transcripts as W

    segments = spark.range(20_000).selectExpr("id AS rec", "0L AS no", "0.0D AS start", "id % 7 + 0.5D AS end", "'one two' AS text")
    start = time.monotonic()
    found = W.planned_windows(segments.repartition(4), "rec")
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.agg(F.count("*"), F.sum("end"), F.sum("ordinal")).first()[:] == (20_000, sum(i % 7 + 0.5 for i in range(20_000)), 20_000)
    assert time.monotonic() - start < 25


def test_uncertainty_searches_a_text_once(spark):
    """markers, quotes and clauses that a query shows are those that the status is made
    of, and one search finds a pattern's matches."""
    plan = registry.queries()["T16_uncertainty"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?:сказал") == 1 and plan.count("бірақ") == 1 and "regexp_extract_all" not in plan
    texts = ["", "a", "ab", "xabyab", "abab", "\ue000ab\ue000", "$0ab\\1", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(K.spans("t", "(a)(b)").alias("s"), K.spans("t", F.lit("a|\\$")).alias("d")).collect()
    plain = lambda p, t: None if t is None else [(m.start(), m.end(), m.group()) for m in re.finditer(p, t)]
    assert [r.s and [tuple(x) for x in r.s] for r in rows] == [plain("ab", t) for t in texts]
    assert [r.d and [tuple(x) for x in r.d] for r in rows] == [plain(r"a|\$", t) for t in texts]


def test_states_are_dealt_by_the_mention_once(spark):
    """what backs and what fells candidates meets them in windows over one deal, and
    repeated candidates stay rows of their own."""
    from ledgerspark.operators import resolution as N

    bit = lambda names, *some: sum(1 << names.index(n) for n in some)
    good, bad = bit(SUPPORT, "name_verified"), bit(AGAINST, "category_conflict")
    rows = [(1, 7, good, 0, False), (1, 7, 0, bad, False), (2, 7, 0, 0, False), (3, 8, good, 0, True), (4, 8, good, 0, False), (4, 9, 0, 0, False)]
    states = spark.createDataFrame(rows, "mention_id long, person_id long, supporting int, conflicting int, verified_collision boolean")
    backed = spark.createDataFrame([(2, 7), (2, 99), (50, 7)], "mention_id long, person_id long")
    collided = spark.createDataFrame([(3, 8), (60, 1)], "mention_id long, collided_person long")
    found = N._supported(states, backed, collided)
    near, fell = bit(SUPPORT, "graph_neighbour"), bit(AGAINST, "endpoint_collision")
    want = [(1, 7, good, 0, None, 7), (1, 7, 0, bad, None, 7), (2, 7, near, 0, None, 7), (3, 8, good, fell, 8, None), (4, 8, good, 0, None, None), (4, 9, 0, 0, None, None)]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, found.select("mention_id", "person_id", "supporting", "conflicting", "collided_person", "chosen").collect()), key=key) == sorted(want, key=key)
    plan = found.groupBy("mention_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
