"""Line deduplication with DataFrame operations only.

Line hashes are range-partitioned, sorted within partitions by document and position, and streamed
once: the stream marks the first occurrence of each line and counts its documents. What comes back
is one run-length compressed drop bitmap per document, never text.

Every line is split and hashed once; the hashes lie in the shared folder and all later passes read
them there. Hot lines: a map-side combined count over all lines finds the keys that hold more than one
in ``HOT_SHARE`` of them (fewer than ``HOT_SHARE`` keys, which bounds their broadcast). Their document
counts come from an aggregate of their own, and their rows are salted by document so that the range
partitioner can spread them.

Defined cases: a null or empty text is one empty line; the empty key (a line of white space) is
never dropped unless ``min_chars`` is 0; repeated (doc_id, text) rows count once; ties for the first
occurrence fall to the smaller (doc_id, text hash, position), nulls first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import SPACES, identified, lower_ascii, same_document, staged

HOT_SHARE = 4096
SALTS = 64


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    key = lower_ascii(F.btrim(F.col("line"), F.lit(SPACES)))
    return (
        docs.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "text_hash", "pos", key.alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), F.col("key")).alias("h2"))
    )


def line_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Drop bitmaps (doc_id, text_hash, drop_runs array<struct<start,len>>) of the documents that lose lines.

    A line key found in at least ``min_docs`` documents loses all its lines, or with ``keep_first``
    all but its first occurrence over the whole corpus.
    """
    lines = staged(_lines(identified(docs), min_chars), "lines")
    limit = lines.count() // HOT_SHARE
    hot_keys = lines.groupBy("h1", "h2").count().filter(F.col("count") > limit).select("h1", "h2") if limit else lines.select("h1", "h2").limit(0)
    hot = (
        lines.join(F.broadcast(hot_keys), ["h1", "h2"], "left_semi")
        .groupBy("h1", "h2", "doc_id", "text_hash").agg(F.min("pos").alias("pos"))
        .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("hot_docs"), F.min(F.struct("doc_id", "text_hash", "pos")).alias("hot_first"))
    )
    salt = F.when(F.col("hot_docs").isNotNull(), F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS))).otherwise(0)
    ranged = lines.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("salt", salt).repartitionByRange("h1", "h2", "salt")
    group = Window.partitionBy("h1", "h2", "salt")
    stream = group.orderBy("doc_id", "text_hash", "pos")
    before = F.lag(F.struct("doc_id", "text_hash")).over(stream)
    counted = ranged.withColumn("new_doc", (~before.eqNullSafe(F.struct("doc_id", "text_hash"))).cast("long")).withColumn(
        "is_first", F.coalesce(F.col("hot_first").eqNullSafe(F.struct("doc_id", "text_hash", "pos")) & F.col("hot_docs").isNotNull(), F.lit(False)) | (F.col("hot_docs").isNull() & (F.row_number().over(stream) == 1))
    )
    counted = counted.withColumn("n_docs", F.coalesce(F.col("hot_docs"), F.sum("new_doc").over(group)))
    dropped = counted.filter((F.col("n_docs") >= min_docs) & (~F.col("is_first") if keep_first else F.lit(True)))
    island = F.col("pos") - F.dense_rank().over(Window.partitionBy("doc_id", "text_hash").orderBy("pos"))
    return (
        dropped.select("doc_id", "text_hash", "pos").withColumn("island", island)
        .groupBy("doc_id", "text_hash", "island").agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + 1).alias("len"))
        .groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("start", "len"))).alias("drop_runs"))
    )


def apply_line_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, keep_runs, kept_text."""
    docs = identified(docs)
    joined = docs.join(bitmaps, same_document(docs, bitmaps), "left").select(
        docs["doc_id"], F.split(docs["text"], "\n", -1).alias("lines"), F.coalesce("drop_runs", F.array().cast("array<struct<start:int,len:int>>")).alias("d")
    )
    n = F.size("lines")

    def gap(i):
        at = F.when(i == 0, 0).otherwise(F.get("d", i - 1)["start"] + F.get("d", i - 1)["len"])
        to = F.when(i == F.size("d"), n).otherwise(F.get("d", i)["start"])
        return F.struct(at.alias("start"), (to - at).alias("len"))

    keep = F.filter(F.transform(F.sequence(F.lit(0), F.size("d")), gap), lambda r: r["len"] > 0)
    runs = joined.select("doc_id", "lines", n.cast("long").alias("n_lines"), F.aggregate("d", F.lit(0).cast("long"), lambda a, r: a + r["len"]).alias("n_dropped"), keep.alias("keep_runs"))
    kept = F.flatten(F.transform("keep_runs", lambda r: F.slice("lines", r["start"] + 1, r["len"])))
    return runs.select("doc_id", "n_lines", "n_dropped", "keep_runs", F.array_join(kept, "\n").alias("kept_text"))


def dedup_lines(docs: DataFrame, **how) -> DataFrame:
    return apply_line_bitmaps(docs, line_bitmaps(docs, **how))
