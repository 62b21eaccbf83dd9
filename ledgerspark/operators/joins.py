"""Join operators (inventory J).

All are equi joins on exploded or derived keys; nothing here is a cross join, and
the size of no side is assumed: Spark picks broadcast or shuffle from statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerspark.functions.text import bound
from ledgerspark.operators.graph import kept
from ledgerspark.operators.predicates import seconds_between


def eligible_recordings(recordings: DataFrame, jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Recordings with a completed job and a result, oldest first."""
    done = jobs.where(F.col("status") == "completed").select("recording_id", "job_id")
    return recordings.join(done, "recording_id").join(results, "recording_id").orderBy("created_at", "recording_id")


def first_occurrences(values: Column) -> Column:
    """Persons of a list of (pos, person_id) structs in order, each once."""
    return F.array_distinct(F.transform(F.sort_array(values), lambda x: x.person_id))


def resolve_mentions(stories: DataFrame, claims: DataFrame, keys: Sequence[str] = ("recording_id", "story_id")) -> DataFrame:
    """Each story's mention ids as the persons that active, resolved mention
    claims give them, in order, each once. Unknown mentions fall out."""
    people = claims.where((F.col("status") == "active") & F.col("person_id").isNotNull()).select("recording_id", "mention_id", "person_id").distinct()
    each = stories.select(*keys, F.posexplode("mention_ids").alias("pos", "mention_id"))
    found = each.join(people, ["recording_id", "mention_id"]).groupBy(*keys).agg(first_occurrences(F.collect_list(F.struct("pos", "person_id"))).alias("person_ids"))
    return stories.select(*keys).join(found, list(keys), "left")


def valid_edges(edges: DataFrame, people: DataFrame, a: str = "subject_person_id", b: str = "object_person_id") -> DataFrame:
    """Edges both of whose ends are known people."""
    known = people.select("person_id").distinct()
    return edges.join(known.withColumnRenamed("person_id", a), a, "left_semi").join(known.withColumnRenamed("person_id", b), b, "left_semi")


def members_with_users(members: DataFrame, users: DataFrame) -> DataFrame:
    """Every membership, with its user where there is one."""
    return members.join(users, "user_id", "left")


def reconcile_inventory(refs: DataFrame, objects: DataFrame, now: Column, min_age_seconds: int, safe: Column | None = None) -> DataFrame:
    """One row per issue (or healthy key) of stored references against objects.

    refs: storage_key, size_bytes, sha256; objects: the same and modified_at. A key
    referenced twice meets its object once. A size is compared only if more than 0
    is expected, a hash only if both are known."""
    want = refs.groupBy("storage_key").agg(F.max("size_bytes").alias("want_size"), F.max("sha256").alias("want_hash"), F.count("*").alias("n_refs"))
    have = objects.groupBy("storage_key").agg(F.max("size_bytes").alias("have_size"), F.max("sha256").alias("have_hash"), F.max("modified_at").alias("modified_at"))
    both = want.join(have, "storage_key", "full")
    known, there = F.col("n_refs").isNotNull(), F.col("have_size").isNotNull()
    age = seconds_between(now, F.col("modified_at"))
    bad_key = ~safe if safe is not None else F.lit(False)
    differs = (F.col("want_size") > 0) & (F.col("want_size") != F.col("have_size"))
    issues = F.array_compact(
        F.array(
            F.when(known & bad_key, "invalid_key"),
            F.when(known & ~bad_key & ~there, "missing"),
            F.when(known & ~bad_key & there & differs, "size_mismatch"),
            F.when(known & ~bad_key & there & (F.col("want_hash") != F.col("have_hash")), "hash_mismatch"),
            F.when(~known & (age >= min_age_seconds), "orphan"),
        )
    )
    state = F.when(F.size(issues) > 0, issues).when(known, F.array(F.lit("healthy"))).otherwise(F.array().cast("array<string>"))
    return both.select("storage_key", F.explode(state).alias("issue"))


def reconciliation_summary(issues: DataFrame) -> DataFrame:
    """Counts of each issue and the verdict."""
    kinds = ("invalid_key", "missing", "size_mismatch", "hash_mismatch", "orphan", "healthy")
    out = issues.agg(*[F.count_if(F.col("issue") == k).alias(k) for k in kinds])
    bad = sum((F.col(k) for k in kinds[:5]), F.lit(0))
    return out.withColumn("verdict", F.when(bad == 0, "PASS").otherwise("FAIL"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key names no parent. A null key names none and is no orphan."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.where(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def dangling_refs(df: DataFrame, id_col: str, array_col: str, target: DataFrame, key: str) -> DataFrame:
    """For each row, the referenced ids that don't exist, sorted; rows without
    one don't appear."""
    each = df.select(id_col, F.explode(array_col).alias("_ref")).distinct()
    lost = each.join(target.select(F.col(key).alias("_ref")).distinct(), "_ref", "left_anti")
    return lost.groupBy(id_col).agg(F.sort_array(F.collect_list("_ref")).alias("missing"))


def contained_conflicts(conflicts: DataFrame, claims: DataFrame, neutral: str = "Conflicting evidence") -> DataFrame:
    """Conflicts whose claims are all included and hold the preferred one."""
    each = conflicts.select("conflict_id", F.explode("claim_ids").alias("claim_id"))
    found = each.join(claims.select("claim_id").distinct().withColumn("_in", F.lit(True)), "claim_id", "left")
    whole = found.groupBy("conflict_id").agg(F.every(F.coalesce("_in", F.lit(False))).alias("whole")).where("whole").select("conflict_id")
    fits = F.col("preferred_claim_id").isNull() | F.array_contains("claim_ids", F.col("preferred_claim_id"))
    return conflicts.where(fits).join(whole, "conflict_id", "left_semi").withColumn("rationale", F.lit(neutral))


def edge_support(edges: DataFrame, claims: DataFrame, people: DataFrame) -> DataFrame:
    """Edges between selected people, with the selected claims that say the same;
    edges without one fall out. Both sides hold type, subject and object in
    canonical order (graph.canonical_relationship)."""
    sane = valid_edges(edges, people)
    said = ["relationship_type", "subject_person_id", "object_person_id"]
    each = sane.select("edge_id", *said, F.explode("source_claim_ids").alias("claim_id"))
    held = each.join(claims.select("claim_id", *said), ["claim_id", *said], "left_semi")
    kept = held.groupBy("edge_id").agg(F.sort_array(F.collect_set("claim_id")).alias("supporting_claim_ids"))
    return sane.join(kept, "edge_id")


def shared_parent_siblings(edges: DataFrame) -> DataFrame:
    """(person_id, sibling_id) both ways: recorded siblings, and children of one
    parent, never oneself. edges: relationship_type, subject (parent), object."""
    a, b = F.col("subject_person_id"), F.col("object_person_id")
    told = edges.where("relationship_type = 'sibling'")
    told = told.select(a.alias("person_id"), b.alias("sibling_id")).union(told.select(b, a))
    child = edges.where("relationship_type = 'parent_child'").select(a.alias("parent"), b.alias("child")).distinct()
    other = child.select("parent", F.col("child").alias("sibling_id"))
    shared = child.join(other, "parent").select(F.col("child").alias("person_id"), "sibling_id")
    return told.union(shared).where("person_id <> sibling_id").distinct()


def shingled(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n, grams): the distinct word k-grams of each text, hashed, and how many the
    text has. Texts of fewer than k words have none and are left out."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")

    def grams(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, k)))
        return F.when(F.size(w) >= k, F.array_distinct(each)).otherwise(none)

    each = df.select(F.col(id_col).alias("id"), F.explode(F.array(bound(hashes, grams))).alias("grams"))
    return each.select("id", F.size("grams").alias("n"), "grams").where("n > 0")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 8, threshold: float = 0.12) -> DataFrame:
    """Pairs (earlier, later) whose k-gram sets have a Jaccard similarity over
    the threshold, exactly, by an inverted index.

    Texts with equal sets are one class: only the first of each is indexed, so copies
    don't multiply candidates, and pairs come back between classes' first rows plus
    each copy with its first row (similarity 1). A set needs only its rarest grams
    in the index: a partner that shares more than t / (1 + t) of both sets' sizes, and
    has at least t of this one's, can't be missed by the first n - floor(t * n) of
    them. What many texts share, a notice or a boilerplate passage, is the most
    frequent of each and mostly falls out, so it doesn't multiply candidates either."""
    spark = df.sparkSession
    tasks = max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Written once: readers that need other columns would each make the grams anew. Two hashes of
    # a set in order, from different seeds, stand for the set.
    sets = kept(
        shingled(df.select(id_col, text_col).repartition(tasks, id_col), id_col, text_col, k)
        .withColumn("grams", F.sort_array("grams"))
        .withColumns({"s1": F.xxhash64("grams"), "s2": F.xxhash64(F.lit(1), "grams")})
    )
    marked = sets.select("id", "n", "s1", "s2")
    firsts = marked.groupBy("n", "s1", "s2").agg(F.min("id").alias("first"))
    copies = marked.join(firsts, ["n", "s1", "s2"]).where("id <> first").select(F.col("first").alias("earlier"), F.col("id").alias("later"), F.lit(1.0).alias("similarity"))
    one = sets.join(firsts.select(F.col("first").alias("id")), "id", "left_semi")
    each = one.select("id", "n", F.explode("grams").alias("gram"))
    shared = each.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(shared, "gram").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("ranked"))
    # Grams of one class only are the rarest: they use up places of the first ones.
    room = (F.col("n") - F.floor(F.lit(threshold) * F.col("n")) - (F.col("n") - F.size("ranked"))).cast("int")
    sized = ranked.select("id", "n", F.transform("ranked", lambda x: x.gram).alias("grams"), F.greatest(room, F.lit(0)).alias("room"))
    first = sized.select("id", "n", F.explode(F.slice("grams", F.lit(1), F.col("room"))).alias("gram"))
    a, b = first.alias("a"), first.alias("b")
    alike = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.id") < F.col("b.id")) & (F.least("a.n", "b.n") > threshold * F.greatest("a.n", "b.n"))
    near = a.join(b, alike).select(F.col("a.id").alias("earlier"), F.col("b.id").alias("later")).distinct()
    left, right = (sized.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("grams").alias(f"of_{name}")) for name in ("earlier", "later"))
    both = near.join(left, "earlier").join(right, "later")
    common = F.size(F.array_intersect("of_earlier", "of_later"))
    scored = both.withColumn("similarity", bound(common, lambda c: c / (F.col("n_earlier") + F.col("n_later") - c)))
    return scored.where(F.col("similarity") > threshold).select("earlier", "later", "similarity").unionByName(copies)


def plan_vs_registry(slots: DataFrame, produced: DataFrame) -> DataFrame:
    """Planned slots, with what was produced in place of the plan; an empty
    profession keeps the planned one."""
    got = produced.select("slot_id", F.col("anchor").alias("_anchor"), F.col("profession").alias("_profession"))
    made = F.col("_anchor").isNotNull() | F.col("_profession").isNotNull()
    return slots.join(got, "slot_id", "left").select(
        "slot_id", F.coalesce("_anchor", "anchor").alias("anchor"), F.coalesce(F.nullif("_profession", F.lit("")), "profession").alias("profession"),
        F.when(made, "done").otherwise(F.col("status")).alias("status"),
    )


def short_year_resolve(mentions: DataFrame, years: DataFrame) -> DataFrame:
    """Two-digit years as the one allowed year that ends so; none allowed: 19xx
    from 30 on, else 20xx; several: ambiguous (null)."""
    ends = years.select("year").distinct().groupBy((F.col("year") % 100).alias("short_year")).agg(F.count("*").alias("n"), F.max("year").alias("only"))
    joined = mentions.join(ends, "short_year", "left")
    guess = F.when(F.col("short_year") >= 30, F.col("short_year") + 1900).otherwise(F.col("short_year") + 2000)
    return joined.select(
        *mentions.columns,
        F.when(F.col("n").isNull(), guess).when(F.col("n") == 1, F.col("only")).alias("resolved_year"),
        F.coalesce(F.col("n") > 1, F.lit(False)).alias("ambiguous"),
    )


def nearest_antecedent(anaphors: DataFrame, mentions: DataFrame, span: int = 420) -> DataFrame:
    """Candidates before an anaphor in its own unit, else in the unit before if
    both units together have at most ``span`` characters; one candidate resolves.

    anaphors: doc_id, unit, pos, unit_chars, prev_chars, anaphor_id, quote; mentions:
    doc_id, unit, pos, mention_id, quote. A bounded as-of join on (doc, unit)."""
    m = mentions.select("doc_id", F.col("unit").alias("m_unit"), F.col("pos").alias("m_pos"), "mention_id", F.col("quote").alias("m_quote"))
    near = anaphors.withColumn("m_unit", F.explode(F.array(F.col("unit"), F.col("unit") - 1))).join(m, ["doc_id", "m_unit"])
    own = F.col("m_unit") == F.col("unit")
    fits = F.when(own, F.col("m_pos") < F.col("pos")).otherwise(F.col("unit_chars") + F.col("prev_chars") <= span)
    near = near.where(fits & F.col("quote").eqNullSafe(F.col("m_quote"))).withColumn("tier", F.when(own, 0).otherwise(1))
    best = near.withColumn("best", F.min("tier").over(Window.partitionBy("doc_id", "anaphor_id"))).where("tier = best")
    out = best.groupBy("doc_id", "anaphor_id").agg(F.sort_array(F.collect_set("mention_id")).alias("candidates"))
    return out.withColumn("status", F.when(F.size("candidates") == 1, "resolved").otherwise("ambiguous"))


def conflict_evidence(conflicts: DataFrame, claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """For each claim of a conflict, the quotes of its own recording that it cites."""
    each = conflicts.select("conflict_id", F.explode("claim_ids").alias("claim_id"))
    cited = each.join(claims.select("claim_id", "recording_id", F.explode("evidence_ids").alias("evidence_id")), "claim_id")
    quotes = cited.join(evidence.select("recording_id", "evidence_id", "text"), ["recording_id", "evidence_id"])
    return quotes.groupBy("conflict_id", "claim_id").agg(F.transform(F.sort_array(F.collect_set(F.struct("evidence_id", "text"))), lambda e: e.text).alias("quotes"))


def gazetteer_mentions(docs: DataFrame, names: DataFrame, most_words: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Names found in texts, the longest first and none inside another.

    Texts are word n-grams of the lengths that names have (up to ``most_words``, if
    given), joined to names by equality. Hits are taken longest first, those of one
    length from the left; a hit falls out if one already taken overlaps it. That is
    decided in each island, a run of hits of a text that overlap one another."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))
    none = F.array().cast("array<struct<pos:int,n:int,name:string>>")

    def of_length(w: Column, n: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.struct(i.alias("pos"), n.alias("n"), F.array_join(F.slice(w, i, n), " ").alias("name")))
        return F.when(F.size(w) >= n, each).otherwise(none)

    named = names.where("name IS NOT NULL").select(F.lower("name").alias("name")).distinct()
    length = F.size(F.split("name", " "))
    lengths = named.where(F.lit(True) if most_words is None else length <= most_words).agg(F.collect_set(length).alias("lengths"))
    grams = bound(words, lambda w: F.flatten(F.transform("lengths", lambda n: of_length(w, n))))
    each = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias(text_col)).crossJoin(F.broadcast(lengths))
    hits = each.select("doc_id", F.explode(grams).alias("g")).select("doc_id", "g.*").join(named, "name")
    order = Window.partitionBy("doc_id").orderBy("pos", "n")
    reached = F.max(F.col("pos") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("starts", F.coalesce(F.col("pos") >= reached, F.lit(True)).cast("int"))
    hits = hits.withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = hits.groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), "pos", "n", "name"))).alias("hits"))

    def beaten(h: Column, o: Column) -> Column:
        return (o.pos < h.pos + h.n) & (h.pos < o.pos + o.n) & ((o.pos != h.pos) | (o.n != h.n))  # a repeated row's own hits stay

    first = F.slice("hits", 1, 0)
    kept = F.aggregate("hits", first, lambda taken, h: F.when(F.exists(taken, lambda o: beaten(h, o)), taken).otherwise(F.concat(taken, F.array(h))))
    return islands.select("doc_id", F.explode(kept).alias("h")).select("doc_id", "h.pos", "h.n", "h.name")


def search_archive(people: DataFrame, stories: DataFrame, query: str, person_id=None, year: int | None = None) -> DataFrame:
    """People by name or alias and stories by title or excerpt that contain the
    query; facets filter stories only; an empty query gives all filtered stories."""
    fold = lambda c: F.translate(F.lower(F.coalesce(c, F.lit(""))), "ё", "е")
    q = query.strip().lower().replace("ё", "е")
    found = stories
    if person_id is not None:
        found = found.where(F.array_contains("person_ids", person_id))
    if year is not None:
        found = found.where(F.array_contains("years", year))
    if q:
        found = found.where(fold(F.col("title")).contains(q) | fold(F.col("excerpt")).contains(q))
    out = found.select(F.lit("story").alias("kind"), F.col("story_id").cast("string").alias("id"), F.col("title").alias("label"))
    if not q:
        return out
    named = people.where(fold(F.col("canonical_name")).contains(q) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: fold(a).contains(q)))
    return out.unionByName(named.select(F.lit("person").alias("kind"), F.col("person_id").cast("string").alias("id"), F.col("canonical_name").alias("label")))
