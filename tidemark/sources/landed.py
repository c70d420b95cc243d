"""Landed venue pages as a source: a folder of JSON lines, read as a table or as a stream.

Each line is a page: venue, endpoint, symbol, payload (the response as text) and ts. Spark's own file source lists the folder, cuts it into
partitions, keeps the offsets of a stream in its checkpoint and reads any store that Spark reads; the same functions take either reading, so
a stream over a folder gives what a table of it gives. Lines that are no pages go to a side table with the file that holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.venues import PATHS, normalize_venue_pages
from tidemark.streaming.stateful import MANY_KEYS, state_store

PAGE = "venue string, endpoint string, symbol string, payload string, ts timestamp"
#: Venues whose pages list many instruments.
LISTING = ("kraken", "dydx", "hyperliquid", "gmx")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of all files, as a table: the columns of PAGE, ``line`` (null where the line is whole) and ``file``."""
    return _with_file(spark.read.schema(f"{PAGE}, line string").option("columnNameOfCorruptRecord", "line").json(folder))


def stream_pages(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """The same as a stream; a batch takes at most ``files_a_batch`` files, the oldest first, and each file once."""
    reader = spark.readStream.schema(f"{PAGE}, line string").option("columnNameOfCorruptRecord", "line").option("maxFilesPerTrigger", files_a_batch)
    return _with_file(reader.json(folder))


def _with_file(lines: DataFrame) -> DataFrame:
    return lines.select("*", F.col("_metadata.file_name").alias("file"))


def page_fault() -> Column:
    """Why a line is no page, null where it is one."""
    single, listing = F.col("venue").isin(*PATHS), F.col("venue").isin(*LISTING)
    return (
        F.when(F.col("line").isNotNull(), "NOT_JSON").when(~F.coalesce(single | listing, F.lit(False)), "UNKNOWN_VENUE").when(F.col("endpoint").isNull(), "NO_ENDPOINT").when(F.col("ts").isNull(), "NO_TIME")
        .when(single & F.col("symbol").isNull(), "NO_SYMBOL").when(F.get_json_object("payload", "$").isNull(), "PAYLOAD_NOT_JSON")
    )


def rejected_pages(lines: DataFrame) -> DataFrame:
    return lines.withColumn("fault", page_fault()).filter("fault is not null")


def landed_quotes(lines: DataFrame, listings: DataFrame, guard: float = 0.10, watermark: str = "10 minutes") -> DataFrame:
    """Canonical quotes of a table or stream of lines.

    The endpoints of a fetch (venue, symbol and time) may lie in different files: a stream holds a fetch until the watermark has passed
    its time.
    """
    return normalize_venue_pages(lines.withWatermark("ts", watermark) if lines.isStreaming else lines, listings, guard, page_fault().isNull())


def land(spark: SparkSession, folder: str, listings: DataFrame, base: str, **how) -> None:
    """Work off what has landed in ``folder`` since the last run into ``base``/quotes and ``base``/rejected, each exactly once by its checkpoint.

    Fetches that wait for the watermark lie in RocksDB, so their number is not bounded by an executor's memory.
    """
    lines = stream_pages(spark, folder)
    for name, rows in (("quotes", landed_quotes(lines, listings, **how)), ("rejected", rejected_pages(lines))):
        with state_store(spark, MANY_KEYS):
            q = rows.writeStream.format("parquet").option("path", f"{base}/{name}").option("checkpointLocation", f"{base}/checkpoint-{name}").trigger(availableNow=True).start()
        q.awaitTermination()
