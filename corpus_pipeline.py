"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, BPE. Each stage's kept rows go on as written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from celltrail.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from celltrail.llm.common import stored_removed, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored 0.3 or more; the model learns from this stage's documents and the labels. Null texts are scored as empty; equal texts alike; no labels, all stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, *COLUMNS[1:]).where("score >= 0.3").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with the repeated lines gone; n_chars is counted anew. Null texts become empty; a row without a doc_id keeps its lines."""
    kept = line_dedup.line_dedup(docs, carried=("lang", "source"))
    return kept.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows kept by near-dedup, which decides by doc_id and text; a null doc_id is its own component, so it stays."""
    docs = docs.select(*COLUMNS, F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    named = docs.where("doc_id is not null")
    kept = near_dedup.near_dedup(named, carried=("text_hash",)).where("kept").select("doc_id", "text_hash").distinct()
    return named.join(kept, ["doc_id", "text_hash"], "left_semi").select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a hit word; equal texts are kept or go alike, null and empty ones stay; without a benchmark all stay."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carried=tuple(COLUMNS[1:]))
    return found.where("size(item_ids) = 0").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and hashes of ids and decoded text, a row each, also for null and empty texts and repeated rows."""
    return bpe.digest(docs)


STAGES = [("quality", good), ("line_dedup", lines), ("near_dedup", distinct), ("decontaminate", clean), ("bpe", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with stored_removed(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
