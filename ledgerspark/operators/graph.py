"""Graph operators (inventory G) over edge tables, by joins and rounds that are
written to the checkpoint folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """df, written to the session's checkpoint folder; the warehouse where none is set."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()


def canonical_relationship(df: DataFrame) -> DataFrame:
    """G1: parents first in parent_child, ends sorted in symmetric types; a relation
    to oneself falls out."""
    a, b = F.col("subject_person_id"), F.col("object_person_id")
    flip = (F.col("relationship_type") == "parent_child") & (F.col("subject_role") == "child")
    symmetric = F.col("relationship_type").isin("spouse", "sibling")
    first = F.when(symmetric, F.least(a, b)).when(flip, b).otherwise(a)
    second = F.when(symmetric, F.greatest(a, b)).when(flip, a).otherwise(b)
    return df.where(a != b).withColumns({"_a": first, "_b": second}).drop("subject_person_id", "object_person_id").withColumnsRenamed({"_a": "subject_person_id", "_b": "object_person_id"})


def family_relations(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Parents, children, siblings and the first spouse of each person."""
    from ledgerspark.operators.joins import shared_parent_siblings

    a, b = F.col("subject_person_id"), F.col("object_person_id")
    kin = edges.where("relationship_type = 'parent_child'")
    pairs = kin.select(b.alias("person_id"), F.lit("parents").alias("kind"), a.alias("other")).union(kin.select(a, F.lit("children"), b))
    married = edges.where("relationship_type = 'spouse'")
    pairs = pairs.union(married.select(a, F.lit("spouse"), b)).union(married.select(b, F.lit("spouse"), a))
    siblings = shared_parent_siblings(edges)
    pairs = pairs.union(siblings.select("person_id", F.lit("siblings"), "sibling_id")).distinct()
    of = lambda k: F.sort_array(F.collect_set(F.when(F.col("kind") == k, F.col("other"))))
    found = pairs.groupBy("person_id").agg(
        *[of(k).alias(k) for k in ("parents", "children", "siblings")], F.min(F.when(F.col("kind") == "spouse", F.col("other"))).alias("spouse_id")
    )
    return people.select("person_id").join(found, "person_id", "left")


def _reached(edges: DataFrame) -> DataFrame:
    """(id, component) of every id on an edge (x, y). Labels pass along edges and then to
    labels of labels, so rounds grow with the logarithm of the longest path."""
    both = kept(edges.select("x", "y").union(edges.select("y", "x")).distinct())
    labels = kept(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("y")).select("id", F.least("id", "y").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        far = step.join(labels.select(F.col("id").alias("next"), F.col("label").alias("far")), "next", "left")
        new = kept(far.select("id", F.col("label").alias("old"), F.least("next", F.coalesce("far", "next")).alias("label")))
        labels = new.select("id", "label")
        if new.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")


def contracted(edges: DataFrame, a: str = "a", b: str = "b", people: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Every id (of an edge or of ``people``) once with the least of its neighbours and
    itself, (id, name), and the edges (x, y) left between names. What hangs on its least
    neighbour needs no edge any more, so stars, however large, leave none."""
    ends = F.greatest(a, b).alias("x"), F.least(a, b).alias("y")
    down = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*ends)
    up = kept(down.groupBy("x").agg(F.min("y").alias("name"), (F.min("y") < F.max("y")).alias("more")))
    more = kept(down.join(up.where("more").select("x", "name"), "x").where("y <> name").select(F.col("name").alias("x"), "y").distinct())
    ids = up.select(F.col("name").alias("id"), F.lit(True).alias("used")).union(more.select("y", F.lit(True)))
    if people is not None:
        ids = ids.union(people.select("id", F.lit(False)).where("id IS NOT NULL"))
    ids = ids.groupBy("id").agg(F.max("used").alias("used"))
    ids = kept(ids.join(up.select(F.col("x").alias("id"), "name"), "id", "left"))
    names = up.select(F.col("x").alias("id"), "name").union(ids.where("name IS NULL").select("id", "id"))
    return names, more.union(ids.where("used AND name <> id").select("id", "name"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", people: DataFrame | None = None) -> DataFrame:
    """(id, component) of every id on an edge, and of every id of ``people`` (id): the
    least id reachable, which for those without an edge is their own. Ids take the least
    neighbour's name first, and only edges that are left between names go through the rounds
    of labels. Edges with a null end link nothing."""
    names, left = contracted(edges, a, b, people)
    found = _reached(left).withColumnRenamed("id", "name")
    return names.join(found, "name", "left").select("id", F.coalesce("component", "name").alias("component"))


def generation_depth(edges: DataFrame, people: DataFrame, most: int = 64) -> DataFrame:
    """0 without a recorded parent, else one more than the deepest parent. After
    ``most`` rounds what still changes lies on or below a cycle and is reported."""
    kin = kept(edges.select(F.col("parent"), F.col("child").alias("person_id")).distinct())
    depth = kept(people.select("person_id", F.lit(0).alias("depth"), F.lit(False).alias("on_cycle")))
    for round_ in range(most + 1):
        above = kin.join(depth.select(F.col("person_id").alias("parent"), F.col("depth").alias("d")), "parent").groupBy("person_id").agg((F.max("d") + 1).alias("d"))
        new = kept(depth.join(above, "person_id", "left").select("person_id", F.coalesce("d", F.lit(0)).alias("depth"), (F.coalesce("d", F.lit(0)) != F.col("depth")).alias("on_cycle")))
        if new.where("on_cycle").isEmpty():
            return new
        depth = new
    return depth


def neighbours(edges: DataFrame) -> Column | DataFrame:
    """Per person the sets of parents, children, spouses and siblings."""
    a, b = F.col("subject_person_id"), F.col("object_person_id")
    kind = F.col("relationship_type")
    one = edges.select(a.alias("person_id"), F.when(kind == "parent_child", "child").otherwise(kind).alias("kind"), b.alias("other"))
    two = edges.select(b, F.when(kind == "parent_child", "parent").otherwise(kind), a)
    return one.union(two).groupBy("person_id").pivot("kind", ["parent", "child", "spouse", "sibling"]).agg(F.sort_array(F.collect_set("other")))
