"""Helpers shared by the training-data operators.

A document is a distinct pair (doc_id, text): rows that repeat both count once as a source of
evidence, yet every input row gets its own output row. A null text reads as the empty text, and a
null doc_id is a value like any other.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
BROADCAST_BYTES = 16 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: bytes.translate table that lower-cases A-Z and leaves every other byte alone.
LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: The same, and every ASCII byte that is no letter or digit becomes a space; bytes of other characters stay.
WORD_TABLE = bytes(LOWER_TABLE[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share; without one a session on one machine gets a folder there, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = _local_folder()
    return path.rstrip("/")


@cache
def _local_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def keep_batches_small(spark: SparkSession) -> None:
    """The same as small_batches for the rest of the session: for results that run when their caller writes them."""
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started within pass at most BATCH_BYTES of rows at once to Python, however long the texts are."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with small_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no result reads any longer."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text with the null text read as empty; every other column is left out."""
    return docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))


def lower_ascii(c: Column) -> Column:
    """A-Z lower-cased, all else kept. lower() is the quick way where all characters are ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def crc_of_id(name: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def small_enough(table: DataFrame, size: Column) -> DataFrame:
    """The table, marked for broadcast if its bytes (``size`` of a row, and 64 more) allow it."""
    total = table.agg(F.sum(size + 64)).first()[0] or 0
    return F.broadcast(table) if total <= BROADCAST_BYTES else table


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_hot_keys_salted(left: DataFrame, right: DataFrame, key: str, rows: int, how: str = "inner", share: int = 512, salts: int = 32) -> DataFrame:
    """``left`` joined with ``right``, which has at most one row a key, on ``key``.

    Keys with more than one in ``share`` of the ``rows`` rows of ``left`` (fewer than ``share`` keys, so their broadcast is
    bounded) are dealt to ``salts`` partitions by a hash of the row, and their rows of ``right`` go to each of these.
    """
    limit = max(rows // share, 1000)
    if rows <= limit:
        return left.join(right, key, how)
    hot = F.broadcast(left.groupBy(key).count().filter(F.col("count") > limit).select(key, F.lit(True).alias("_hot")))
    others = [F.col(f"`{c}`") for c, kind in left.dtypes if c != key and not kind.startswith("map")]
    dealt = left.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*others), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    every = F.sequence(F.lit(0), F.when(F.col("_hot"), salts - 1).otherwise(0))
    copied = right.join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")
