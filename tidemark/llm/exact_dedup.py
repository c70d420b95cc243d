"""Exact deduplication by Patricia-trie owners.

Texts are dealt out by (length, content hash). An owner inserts whole byte strings into a compressed
radix trie whose terminal nodes hold the smallest identifier and the number of rows; so equality is
that of bytes, not of hashes. Two trie passes run: one per input partition, which shrinks a group of
copies to one row per partition before anything is shuffled, and one per owner partition, which
merges those rows. A trie that outgrows its budget spills whole subtrees: their terminals leave as
partial rows, which the owner merges like any others.

Defined cases: a null text equals the empty text; of equal texts the smallest doc_id stays, nulls
last; rows that repeat a doc_id and text count each in group_size, and every one of them is kept or
dropped alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import text_of

TRIE_BYTES = 48 << 20
WHITE = r"[\x20\x09-\x0D]+"
ENTRY = "n_bytes long, h long, body binary, min_id long, n long"


class RadixTrie:
    """Compressed radix trie over byte strings; a node is [children by first byte, terminal or None, label]."""

    def __init__(self) -> None:
        self.root: list = [{}, None, b""]
        self.size = 0

    def insert(self, text: bytes, key: tuple, min_id: int | None, n: int) -> None:
        """Add n rows of a text. A terminal is [key, smallest id, rows, text]."""
        node, at, end = self.root, 0, len(text)
        while at < end:
            child = node[0].get(text[at])
            if child is None:
                node[0][text[at]] = [{}, [key, min_id, n], text[at:]]
                self.size += end - at + 300
                return
            label = child[2]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same = self._common(label, text, at)
            upper = [{label[same]: child}, None, label[:same]]
            child[2] = label[same:]
            node[0][text[at]] = upper
            self.size += 300
            node, at = upper, at + same
        if node[1] is None:
            node[1] = [key, min_id, n]
        else:
            old = node[1]
            if old[1] is None or (min_id is not None and min_id < old[1]):
                old[1] = min_id
            old[2] += n

    @staticmethod
    def _common(label: bytes, text: bytes, at: int) -> int:
        low, high = 0, min(len(label), len(text) - at)
        while low < high:
            mid = (low + high + 1) // 2
            if text.startswith(label[:mid], at):
                low = mid
            else:
                high = mid - 1
        return low

    def drain(self) -> Iterator[tuple[bytes, list]]:
        """Yield (text, terminal) of every terminal and empty the trie, a subtree of the root at a time."""
        if self.root[1] is not None:
            yield b"", self.root[1]
            self.root[1] = None
        for first in sorted(self.root[0]):
            yield from self._walk(self.root[0].pop(first))
        self.size = 0

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Drain subtrees of the root, in order, until half of the budgeted bytes are free."""
        for first in sorted(self.root[0])[: max(1, (len(self.root[0]) + 1) // 2)]:
            for text, terminal in self._walk(self.root[0].pop(first)):
                self.size = max(0, self.size - len(text) - 300)
                yield text, terminal

    @staticmethod
    def _walk(node: list) -> Iterator[tuple[bytes, list]]:
        stack = [(node, b"")]
        while stack:
            (children, terminal, label), above = stack.pop()
            text = above + label
            if terminal is not None:
                yield text, terminal
            stack.extend((children[b], text) for b in sorted(children, reverse=True))


def _batch(entries: list[tuple[bytes, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([t[0][0] for _, t in entries], pa.int64()),
            pa.array([t[0][1] for _, t in entries], pa.int64()),
            pa.array([x for x, _ in entries], pa.binary()),
            pa.array([t[1] for _, t in entries], pa.int64()),
            pa.array([t[2] for _, t in entries], pa.int64()),
        ],
        names=["n_bytes", "h", "body", "min_id", "n"],
    )


def _batches(entries: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for e in entries:
        part.append(e)
        size += len(e[0])
        if size > 4 << 20 or len(part) >= 4000:
            yield _batch(part)
            part, size = [], 0
    if part:
        yield _batch(part)


def _through_tries(budget: int):
    """mapInArrow function over ENTRY rows. Rows may come in any order; equal texts merge while their subtree is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie()
        for b in batches:
            for n_bytes, h, body, min_id, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                trie.insert(body, (n_bytes, h), min_id, n)
                if trie.size > budget:
                    yield from _batches(trie.spill())
        yield from _batches(trie.drain())

    return run


def _owners_of_runs(budget: int):
    """mapInArrow function over ENTRY rows sorted by (n_bytes, h): a trie is drained only between two runs of equal
    length and hash, so each distinct text leaves exactly once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = RadixTrie(), None
        for b in batches:
            for n_bytes, h, body, min_id, n in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if trie.size > budget and (n_bytes, h) != last:
                    yield from _batches(trie.drain())
                last = (n_bytes, h)
                trie.insert(body, last, min_id, n)
        yield from _batches(trie.drain())

    return run


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id and the text with every run of white space replaced by one space, its length, hash and SHA-256."""
    body = F.regexp_replace(text_of(), WHITE, " ")
    return docs.select("doc_id", body.alias("body")).select(
        "doc_id", F.octet_length("body").cast("long").alias("n_bytes"), F.xxhash64("body").alias("h"), F.sha2("body", 256).alias("text_sha256"), "body"
    )


def normalised_sha256(text: Column) -> Column:
    """text_sha256 of a text column."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " "), 256)


def text_owners(docs: DataFrame, budget: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct normalised text: n_bytes, h, text_sha256, keep_id, group_size."""
    rows = normalised(docs).select("n_bytes", "h", F.col("body").cast("binary").alias("body"), F.col("doc_id").cast("long").alias("min_id"), F.lit(1).cast("long").alias("n"))
    partial = rows.mapInArrow(_through_tries(budget), ENTRY)
    owned = partial.repartition("n_bytes", "h").sortWithinPartitions("n_bytes", "h").mapInArrow(_owners_of_runs(budget), ENTRY)
    return owned.select("n_bytes", "h", F.sha2("body", 256).alias("text_sha256"), F.col("min_id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame, budget: int = TRIE_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    members, owners = normalised(docs).drop("body"), text_owners(docs, budget)
    return members.join(owners, ["n_bytes", "h", "text_sha256"], "left").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
