"""A corpus pipeline: quality rules, near duplicates, benchmark decontamination,
secrets, tokens. Each stage is written and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import bpe_stream, decontaminate, jaccard_join, quality, secrets
from ledgerspark.llm.common import written


def own_columns(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The columns of docs, without the one that a stage added."""
    return found.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null, empty and very short texts go; repeated rows
    are judged alike; an empty table gives no rows; other columns pass, whatever their
    names."""
    out = quality.private("_quality", docs.columns)
    return own_columns(docs, quality.judge(docs, out=out).where(F.col(f"{out}.kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, and every row of an empty set (null, empty
    and blank texts). The row of the smallest doc_id stays, null last; of repeated rows
    that of the least values. Rows that repeat a doc_id, or have none, are judged by
    their own texts, so they all stay if their texts are of different groups."""
    return jaccard_join.one_of_each(docs, k=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts have none and
    stay, as do all rows where the benchmark is empty; repeated rows are judged alike;
    other columns pass, whatever their names."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = quality.private("_scan", docs.columns)
    return own_columns(docs, decontaminate.scan_benchmark(docs, benchmark, out=out).where(F.size(f"{out}.words") == 0))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by its kind in brackets; overlapping ones
    are one. Null texts stay null, repeated rows stay, other columns pass."""
    return secrets.without_secrets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, number of tokens, ids (little-endian 32-bit) and a digest of
    the text that the ids decode to; a row for each row. Null and empty texts have no
    tokens; other columns are left out. A text's ids are one value: what is very long
    takes as much memory as its ids."""
    found = bpe_stream.encode_column(docs.select("doc_id", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), out="_bpe")
    return found.select(
        "doc_id", "source", F.col("_bpe.n_tokens").alias("n_tokens"), F.col("_bpe.ids").alias("ids"), F.sha2("_bpe.decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", secrets_masked),
    ("BPE encoding", tokens),
]

#: SQL can't express the divergence rules' corpus histograms and the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
