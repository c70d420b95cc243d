"""WARC archives by way of a chunked record table.

A payload is cut into rows (record id, chunk number) of at most CHUNK bytes, each with the digest of
the payload up to its end, so no step holds a whole oversized record but the input row itself. Each
chunk becomes one WARC record: ``response`` or ``revisit``, and ``continuation`` for the segments
after the first, as the WARC standard has it. Spark's text writer lays the records down in the shared
folder, one archive per task; a boundary field that is new for every archive set, right after the
version line, lets Spark's text reader split archives at records, wherever a file is cut. Reading
checks every length and every running digest.

Of records with equal payloads of at least LEAST bytes the one with the smallest page_id is the
response and the others revisit it.

Defined cases: a null html is the empty payload; payloads under LEAST bytes are always responses;
rows that repeat page_id and payload are responses alike; a null page_id revisits any owner that has
an id, and is a response otherwise; null urls have no target field.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import fresh_path, small_enough, staged

CHUNK = 1 << 20
LEAST = 100
CHUNK_ROW = "record_id string, chunk_no int, chunks int, body binary, running string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def typed_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    heads = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    named = heads.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("pages"))
    # Payloads that stand alone own themselves; the others are few as a rule, and then payloads need not move.
    owners = small_enough(staged(named.filter("pages > 1 and owner is not null").drop("pages"), "owners"), F.lit(64))
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    joined = heads.join(owners, "payload_digest", "left")
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("owner"))).drop("owner")


def chunk_table(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk; a revisit has a single empty chunk. ``running`` is the payload's digest up to the chunk's end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("chunk_no", pa.int32()), ("chunks", pa.int32()), ("body", pa.binary()), ("running", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        for b in batches:
            rows, size = [], 0
            for i in range(b.num_rows):
                r = {name: b.column(name)[i] for name in b.schema.names}
                payload = memoryview(r["payload"].as_buffer())
                same = {k: r[k].as_py() for k in ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest")}
                record_id = f"urn:uuid:{uuid.uuid4()}"
                pieces = [payload[:0]] if same["record_type"] == "revisit" else [payload[at : at + chunk] for at in range(0, max(1, len(payload)), chunk)]
                digest = hashlib.sha256()
                for k, piece in enumerate(pieces):
                    digest.update(piece)
                    rows.append({"record_id": record_id, "chunk_no": k + 1, "chunks": len(pieces), "body": bytes(piece), "running": digest.copy().hexdigest(), **same})
                    size += len(piece)
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    wanted = records.select(F.col("page_id").cast("long"), "url", "payload", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))
    return wanted.mapInArrow(cut, CHUNK_ROW)


def _field(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise("")


def boundary_of(token: str) -> str:
    return f"WARC/1.1\r\nWARC-Boundary: {token}\r\n"


def write_archives(chunks: DataFrame, path: str, token: str) -> None:
    """Gzipped archives under ``path``."""
    several = F.col("chunks") > 1
    kind = F.when(F.col("chunk_no") > 1, "continuation").otherwise(F.col("record_type"))
    head = F.concat(
        F.lit(boundary_of(token)),
        _field("WARC-Type", kind),
        _field("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(":"), F.col("chunk_no").cast("string"), F.lit(">"))),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        _field("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]+", "%20")),
        F.when(several, F.concat(_field("WARC-Segment-Number", F.col("chunk_no")), _field("WARC-Segment-Origin-ID", F.concat(F.lit("<"), "record_id", F.lit(":1>"))))).otherwise(""),
        F.when(several & (F.col("chunk_no") == F.col("chunks")), _field("WARC-Segment-Total-Length", F.col("payload_bytes"))).otherwise(""),
        _field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2("body", 256))),
        _field("WARC-Running-Digest", F.concat(F.lit("sha256:"), "running")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        _field("WARC-Payload-Length", F.col("payload_bytes")),
        _field("WARC-Page-ID", F.col("page_id")),
        _field("WARC-Refers-To-Page-ID", F.col("refers_to")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _field("Content-Length", F.octet_length("body")),
        F.lit("\r\n"),
    )
    line = F.concat(head.cast("binary"), F.col("body"), F.lit("\r\n").cast("binary")).cast("string")
    chunks.select(line.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str, token: str) -> DataFrame:
    """The chunk rows of the archives under ``path``: every block's length and digest is checked."""
    raw = spark.read.option("lineSep", boundary_of(token)).text(path).filter("value <> ''")
    head = F.substring_index("value", "\r\n\r\n", 1)
    cut = raw.select(F.concat(F.lit("\n"), head, F.lit("\r")).alias("head"), F.col("value").cast("binary").alias("bytes"), (F.octet_length(head) + 4).alias("at"))

    def has(name: str) -> Column:
        found = F.regexp_extract("head", rf"\n{name}: ([^\r]*)\r", 1)
        return F.when(found != "", found)

    length = has("Content-Length").cast("int")
    body = F.substring(F.col("bytes"), F.col("at") + 1, length)
    rows = cut.select(
        F.regexp_extract("head", r"\nWARC-Record-ID: <(.*):\d+>\r", 1).alias("record_id"),
        F.coalesce(has("WARC-Segment-Number").cast("int"), F.lit(1)).alias("chunk_no"),
        has("WARC-Segment-Number").isNotNull().alias("segmented"),
        has("WARC-Type").alias("record_type"),
        has("WARC-Page-ID").cast("long").alias("page_id"),
        has("WARC-Refers-To-Page-ID").cast("long").alias("refers_to"),
        has("WARC-Payload-Length").cast("long").alias("payload_bytes"),
        F.substring_index(has("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        F.substring_index(has("WARC-Block-Digest"), ":", -1).alias("block_digest"),
        F.substring_index(has("WARC-Running-Digest"), ":", -1).alias("running"),
        F.when(F.octet_length("bytes") == F.col("at") + length + 4, body).alias("body"),
    )
    sound = F.coalesce(F.sha2("body", 256) == F.col("block_digest"), F.lit(False))
    return rows.withColumn("body", F.when(sound, F.col("body")).otherwise(F.raise_error(F.concat(F.lit("broken WARC record "), F.col("record_id"))).cast("binary"))).drop("block_digest")


def read_records(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, from its chunks."""
    whole = chunks.filter(~F.col("segmented"))
    is_revisit = F.col("record_type") == "revisit"
    single = whole.select("page_id", F.when(is_revisit, F.col("payload_bytes")).otherwise(F.octet_length("body").cast("long")).alias("payload_bytes"), F.when(is_revisit, F.col("payload_digest")).otherwise(F.sha2("body", 256)).alias("payload_digest"), "record_type", "refers_to")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, digest, size, first, rows = None, None, 0, None, []
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

        def done() -> dict:
            if size != first["payload_bytes"]:
                raise ValueError(f"WARC record {record} lacks a segment")
            return {"page_id": first["page_id"], "payload_bytes": size, "payload_digest": digest.hexdigest(), "record_type": first["record_type"], "refers_to": first["refers_to"]}

        for b in batches:
            for i in range(b.num_rows):
                r = {k: b.column(k)[i].as_py() for k in b.schema.names if k != "body"}
                if r["record_id"] != record:
                    if record is not None:
                        rows.append(done())
                    record, digest, size, first = r["record_id"], hashlib.sha256(), 0, r
                block = memoryview(b.column("body")[i].as_buffer())
                digest.update(block)
                size += len(block)
                if digest.copy().hexdigest() != r["running"]:
                    raise ValueError(f"WARC record {record} has a broken segment {r['chunk_no']}")
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
        if record is not None:
            yield pa.RecordBatch.from_pylist([done()], schema)

    parts = chunks.filter("segmented").select("record_id", "chunk_no", "running", "page_id", "payload_bytes", "record_type", "refers_to", "body")
    several = parts.repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(joined, single.schema)
    return single.unionByName(several)


def archive_round_trip(pages: DataFrame, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """Write the archives of all pages into the shared folder and return the records that are read back."""
    spark = pages.sparkSession
    token, path = uuid.uuid4().hex, fresh_path(spark, "warc")
    write_archives(chunk_table(typed_records(pages, least), chunk), path, token)
    return read_records(read_archives(spark, path, token))
