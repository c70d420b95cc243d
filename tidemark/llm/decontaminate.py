"""Benchmark decontamination: a prefix-filtered containment join over item-sized windows.

Every benchmark item is cut into windows of WINDOW consecutive words (a shorter item is one window).
A window can only occur where all its words occur, so for full containment one prefix word is
enough: words are ordered by their frequency over all documents, and each window is filed under its
rarest word with that word's place in the window. Document words that are no window's prefix are
passed over; at the others the place gives the only possible start, length and position bounds cut
what does not fit, and the window's words are compared one by one.

The benchmark goes out in blocks of at most about BLOCK_WORDS window words. A block passes through the
driver and is broadcast on its own; where there are several, its hits are written to the shared folder,
by document, and its broadcast is given up before the next block, so what is held at once is bounded
however large the benchmark is. The hits of all blocks are merged by document.

Defined cases: null and empty texts have no words and are clean; items without words have no window;
a null item_id takes part but is left out of the list of ids; equal windows of several items hit
each of them; repeated rows are judged alike.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import WORD_TABLE, fresh_path, identified, text_of

WINDOW = 10
BLOCK_WORDS = 4_000_000


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, A-Z lower-cased."""
    return text.translate(WORD_TABLE).split()


def windows_of(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


@dataclass(frozen=True)
class WindowIndex:
    """prefix word -> [(its place in the window, the window's words, item ids)]"""

    by_prefix: dict[bytes, list[tuple[int, list[bytes], tuple[int, ...]]]]


def build_index(windows: dict[tuple[bytes, ...], set], frequency: dict[bytes, int]) -> WindowIndex:
    by_prefix: dict = {}
    for window, items in windows.items():
        at = min(range(len(window)), key=lambda i: (frequency.get(window[i], 0), window[i], i))
        by_prefix.setdefault(window[at], []).append((at, list(window), tuple(items)))
    return WindowIndex(by_prefix)


def hits_of(index: WindowIndex, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Merged [from, to) runs of hit words, and the items whose windows occur."""
    by_prefix, spans, items = index.by_prefix, [], set()
    for p, w in enumerate(words):
        if w in by_prefix:
            for at, window, own in by_prefix[w]:
                start = p - at
                if start >= 0 and start + len(window) <= len(words) and words[start : start + len(window)] == window:
                    spans.append((start, start + len(window)))
                    items.update(own)
    return merge_runs(spans), items


def merge_runs(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def word_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of a (bounded) vocabulary stands in all documents; summed per task before the shuffle."""
    wanted = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(filter(wanted.value.__contains__, words_of(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(text_of().cast("binary").alias("text")).mapInArrow(count, "word binary, n long")
    return {bytes(r[0]): r[1] for r in counted.groupBy("word").agg(F.sum("n")).collect()}


HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.LongType())),
    ]
)


def _hits_udf(index):
    @F.arrow_udf(HITS)
    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.int64()))])
        for texts in batches:
            out = []
            for t in texts:
                words = words_of(t.as_py())
                runs, items = hits_of(index.value, words)
                out.append({"n_words": len(words), "runs": [{"start": a, "stop": b} for a, b in runs], "items": sorted(i for i in items if i is not None)})
            yield pa.array(out, kind)

    return hits


def benchmark_blocks(benchmark: DataFrame, size: int, block_words: int) -> Iterator[dict[tuple[bytes, ...], set]]:
    """The distinct windows of the benchmark with their items, in blocks of about block_words words."""
    items = benchmark.select("item_id", text_of().alias("text"))
    words = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-words * size // 2 // block_words))
    keyed = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for k in range(blocks):
        windows: dict = {}
        for item, text in keyed.filter(F.col("block") == k).select("item_id", F.col("text").cast("binary")).toLocalIterator():
            for w in windows_of(words_of(bytes(text)), size):
                windows.setdefault(w, set()).add(item)
        yield windows


def _summary_udf():
    kind = pa.struct([("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string())])

    @F.arrow_udf("struct<n_hit:bigint,n_items:bigint,items_sha256:string>")
    def summary(found: pa.Array) -> pa.Array:
        out = []
        for f in found:
            f = f.as_py()
            runs = merge_runs([(r["start"], r["stop"]) for r in f["runs"]])
            items = sorted(map(str, set(f["items"])))
            out.append({"n_hit": sum(b - a for a, b in runs), "n_items": len(items), "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest()})
        return pa.array(out, kind)

    return summary


def _index_of(docs: DataFrame, windows: dict[tuple[bytes, ...], set]):
    """The broadcast index of a block of windows."""
    frequency = word_frequencies(docs, {w for window in windows for w in window})
    return docs.sparkSession.sparkContext.broadcast(build_index(windows, frequency))


def _count_udf():
    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array([len(words_of(t.as_py())) for t in texts], pa.int64())

    return count


def with_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS, into: str = "found") -> DataFrame:
    """``docs`` with a column ``into`` (n_words, hit runs, item ids)."""
    blocks = benchmark_blocks(benchmark, size, block_words)
    first, second = next(blocks), next(blocks, None)
    text = text_of().cast("binary")
    if second is None:
        return docs.withColumn(into, _hits_udf(_index_of(docs, first))(text))
    path, known = fresh_path(docs.sparkSession, "hits"), identified(docs)
    for windows in chain([first, second], blocks):
        index = _index_of(docs, windows)
        found = known.withColumn("f", _hits_udf(index)(text)).filter(F.size("f.runs") > 0)
        found.select("doc_id", "text_hash", "f.runs", "f.items").distinct().write.mode("append").parquet(path)
        index.destroy()
    hits = docs.sparkSession.read.schema(known.select("doc_id", "text_hash").schema.add("runs", HITS["runs"].dataType).add("items", HITS["items"].dataType)).parquet(path)
    merged = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("text_hash").alias("hit_hash")).agg(F.flatten(F.collect_list("runs")).alias("hit_runs"), F.flatten(F.collect_list("items")).alias("hit_items"))
    own = [docs[f"`{c}`"] for c in docs.columns]
    joined = docs.join(merged, docs["doc_id"].eqNullSafe(merged["hit_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == merged["hit_hash"]), "left")
    part = lambda name: F.coalesce(merged[f"hit_{name}"], F.array().cast(HITS[name].dataType)).alias(name)
    words = _count_udf()(F.coalesce(docs["text"], F.lit("")).cast("binary")).alias("n_words")
    return joined.select(*own, F.struct(words, part("runs"), part("items")).alias(into))


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_runs for every row."""
    found = with_hits(identified(docs).select("doc_id", "text"), benchmark, size, block_words).select("doc_id", "found")
    s = found.withColumn("s", _summary_udf()("found"))
    return s.select("doc_id", F.col("found.n_words").alias("n_words"), "s.n_hit", "s.n_items", "s.items_sha256", (F.col("s.n_hit") > 0).alias("contaminated"), F.col("found.runs").alias("hit_runs"))
