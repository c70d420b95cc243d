"""A corpus pipeline: toxic documents go, copies and near copies go, benchmark leaks go, sources are mixed.

Every stage reads what the stage before wrote. The session keeps to small Arrow batches from the first stage on.
Stages run in the same executors, whose Python workers and buffers keep what their largest batch took. Filtering stages return the columns of documents.
Near copies are linked by the SimHash operator, or have 0.8 or more of their five-word shingles in common (near_copies.py).
A document is a pair of doc_id and text: the rows that go are named by both, so that others of the same or no doc_id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import with_hits
from tidemark.llm.exact_dedup import exact_dedup, normalised_sha256
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_copies import near_copies
from tidemark.llm.shared import discard, free_name, keep_batches_small, staged, text_of
from tidemark.llm.simhash import RADIUS
from tidemark.llm.toxicity import THRESHOLD, score_udf, train_toxicity

NEAR_SHINGLE = 5
NEAR_SIMILARITY = 0.8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep_batches_small(spark)
    model = train_toxicity(docs, _table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxic_score")
    return docs.withColumn(score, score_udf(model)(text_of().cast("binary"))).filter(F.col(score) < THRESHOLD).drop(score)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep_batches_small(spark)
    gone = exact_dedup(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_text")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (normalised_sha256(docs["text"]) == gone["gone_text"]), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_copies(docs, NEAR_SHINGLE, NEAR_SIMILARITY, radius=RADIUS).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone["gone_text"]), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep_batches_small(spark)
    found = free_name(docs, "found")
    return with_hits(docs, _table(spark, sf_dir, "benchmark"), into=found).filter(F.size(f"{found}.runs") == 0).drop(found)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("decontamination", drop_leaks), ("mixing", mix)]

#: SQL has no zstandard, XXH64 or schedule; tests/llm hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            discard(before)
    return docs
