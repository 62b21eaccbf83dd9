"""Reading and writing: corpora as JSON, object listings, and the results of
extractions turned into ledger rows. Folders are any path Spark can open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark.operators.predicates import stable_id

#: Object arrays of an extraction: (field, object type, id field, predicate field or
#: the predicate itself). Fixed values.
OBJECTS = (
    ("people_mentions", "person_mention", "mention_id", "'person_mention'"),
    ("relationship_claims", "relationship", "relationship_id", "relationship_type"),
    ("events", "event", "event_id", "event_type"),
    ("descriptions", "description", "description_id", "'description'"),
    ("stories", "story", "story_id", "'story'"),
    ("unresolved_questions", "unresolved_question", "question_id", "'question'"),
)

_SPAN = "struct<evidence_id:string,text:string,start_ms:bigint,end_ms:bigint,source_segment_ids:array<string>>"


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object a file, with the file's name. Files that aren't objects of the
    schema give nulls."""
    df = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)
    return df.select("*", F.col("_metadata.file_name").alias("file_name"))


def write_corpus(df: DataFrame, path: str, id_col: str = "sample_id") -> None:
    """JSON lines in order of the id, over as many files as the sort has ranges."""
    df.sort(id_col).write.option("ignoreNullFields", False).json(path)


def write_plan(df: DataFrame, path: str) -> None:
    """CSV files with a header."""
    df.write.option("header", True).csv(path)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """storage_key, size_bytes and modified_at of the files below a folder; their
    content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("storage_key"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def exploded_claims(results: DataFrame) -> DataFrame:
    """One row an object of an extraction: recording_id, object_type,
    source_object_id, predicate, payload (JSON) and a claim_id that follows from these.

    results: recording_id, extraction (JSON). Objects without an id are left out, as
    are arrays that aren't there."""
    arrays = T.StructType([T.StructField(name, T.ArrayType(T.StringType())) for name, *_ in OBJECTS])
    parsed = results.select("recording_id", F.from_json("extraction", arrays).alias("x"))

    def field(name: str) -> Column:
        return F.lit(name[1:-1]) if name.startswith("'") else F.get_json_object("payload", f"$.{name}")

    def tagged(name: str) -> Column:
        array = F.coalesce(f"x.{name}", F.array().cast("array<string>"))
        return F.transform(array, lambda p: F.struct(F.lit(name).alias("name"), p.alias("payload")))

    # One pass: the arrays become one array of (type, payload), exploded once.
    rows = parsed.select("recording_id", F.explode(F.concat(*[tagged(name) for name, *_ in OBJECTS])).alias("o")).select("recording_id", "o.name", "o.payload")
    pick = lambda make: reduce(lambda c, o: c.when(F.col("name") == o[0], make(o)), OBJECTS[1:], F.when(F.col("name") == OBJECTS[0][0], make(OBJECTS[0])))
    named = rows.select("recording_id", pick(lambda o: F.lit(o[1])).alias("object_type"), pick(lambda o: field(o[2])).alias("source_object_id"), pick(lambda o: field(o[3])).alias("predicate"), "payload")
    named = named.where(F.coalesce("source_object_id", F.lit("")) != "")
    return named.withColumn("claim_id", stable_id("claim", F.col("recording_id"), F.col("object_type"), F.col("source_object_id"), F.col("payload")))


def exploded_evidence(results: DataFrame) -> DataFrame:
    """Evidence spans of extractions; those without an id are left out."""
    spans = F.from_json("extraction", f"struct<evidence_spans:array<{_SPAN}>>")["evidence_spans"]
    rows = results.select("recording_id", F.explode(spans).alias("s")).select("recording_id", "s.*")
    rows = rows.withColumn("source_segment_ids", F.coalesce("source_segment_ids", F.array().cast("array<string>")))
    return rows.where(F.coalesce("evidence_id", F.lit("")) != "")


def exploded_corrections(results: DataFrame) -> DataFrame:
    """Corrections of cleaned transcripts, each with an id that follows from its
    recording and content: recording_id, corrections (array of structs)."""
    rows = results.select("recording_id", F.explode("corrections").alias("c"))
    return rows.select(stable_id("correction", F.col("recording_id").cast("string"), F.to_json("c")).alias("correction_id"), "recording_id", "c.*").dropDuplicates(["correction_id"])


def object_manifest(recordings: DataFrame, exports: DataFrame) -> DataFrame:
    """Stored objects of recordings and exports: kind, storage_key, sha256,
    size_bytes. Rows without a key are left out."""
    cols = ["storage_key", "sha256", "size_bytes"]
    both = recordings.select(F.lit("audio").alias("kind"), *cols).unionByName(exports.select(F.lit("book").alias("kind"), *cols))
    return both.where("storage_key IS NOT NULL")


def write_family_export(tables: dict[str, DataFrame], path: str) -> None:
    """Each table in a folder of its own, one partition a family: one family's
    snapshot is read, or deleted, without the others."""
    for name, df in tables.items():
        df.repartition("family_id", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.partitionBy("family_id").json(f"{path.rstrip('/')}/{name}")


def family_export(spark: SparkSession, path: str, table: str, family_id) -> DataFrame:
    """One family's rows of an exported table; only its partition is read."""
    return spark.read.json(f"{path.rstrip('/')}/{table}").where(F.col("family_id") == F.lit(family_id))
