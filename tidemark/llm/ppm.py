"""Language-model scores by prediction by partial matching, with a smoothed word model as base line.

A byte-context trie of order ORDER is counted over all training documents, whole: nothing is cut, so
what is learned grows with the corpus. Scoring goes from the longest context down: escape probability
by method C (distinct symbols over occurrences plus distinct symbols), and symbol exclusion, i.e. what
a longer context could have said is taken out of the shorter one. As a context's symbols are always
among its suffix's, what is excluded depends on the escaping context alone, so all totals are
precomputed per context.

The probability of a byte depends on its gram (ORDER bytes of context and the byte) alone. So a task
cuts its documents into chunks and sends each chunk's distinct grams, packed in blobs, to shards by
their last three context bytes. All contexts of three bytes and more lie whole in one shard; the shorter
ones (at most 257^3 entries, far fewer in UTF-8 text) are broadcast. A shard merges the counts of all
chunks, answers each chunk's grams with their log probabilities, and the answers meet the chunk's texts
by a shuffle on the chunk. No task holds more than a shard of the trie or the grams of a chunk.

Frequent words (at most FREQUENT) are broadcast, all others reach their documents by a shuffle join, so
the base score is exact.

Defined cases: null and empty texts have the end token alone; without training documents every count
is 0 and the score is that of uniform bytes; repeated rows are scored alike and all train; a text of any
length is worked on in pieces of PIECE bytes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import LOWER_TABLE, crc_of_id, discard, staged, text_of

ORDER = 5
#: Sizes of grams whose contexts may span shards.
LOW = 3
FREQUENT = 1 << 17
#: Bytes that no UTF-8 text has: before a text, and after it.
PAD, END = 0xFE, 0xFF
#: Bytes worked on at once: the arrays of counting are some forty times as large, those of look-ups twenty times.
PIECE = 512 << 10
SCORED_AT_ONCE = 256 << 10
#: Bytes of text in a chunk before it is closed, and of all text to a shard.
CHUNK = 16 << 20
SHARD = 16 << 20
MOST_SHARDS = 16_384
ENTRIES_AT_ONCE = 1 << 20
FLUSH = 400_000


def held_out(name: str = "doc_id") -> Column:
    return F.pmod(crc_of_id(name), F.lit(7)) == 2


def pieces(text: bytes, size: int) -> Iterator[bytes]:
    """The text and its end in pieces of at most ``size`` bytes, each after the ORDER bytes before it."""
    whole = bytes([PAD]) * ORDER + text + bytes([END])
    for at in range(ORDER, len(whole), size):
        yield whole[at - ORDER : at + size]


def _grams(parts: list[bytes]):
    """Packed (context, byte) of every byte of the pieces, and where each piece starts."""
    import numpy as np

    body = np.frombuffer(b"".join(parts), np.uint8)
    sizes = np.array([len(p) - ORDER for p in parts])
    packed = np.zeros(len(body) - ORDER, np.uint64)
    for i in range(ORDER + 1):
        packed = (packed << np.uint64(8)) | body[i : len(body) - ORDER + i]
    keep = np.ones(len(packed), bool)
    for s in (np.cumsum(sizes + ORDER)[:-1]).tolist():
        keep[s - ORDER : s] = False
    return packed[keep], np.concatenate(([0], np.cumsum(sizes)[:-1]))


def _in_batches(texts: Iterator[bytes], limit: int) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def _lowered(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for b in batches:
        for t in b.column(0):
            yield t.as_py().translate(LOWER_TABLE)


class Tally:
    """Counts of grams, added up array by array; what waits is merged once it outgrows what is held."""

    def __init__(self) -> None:
        self.parts, self.waiting, self.held = [], 0, 0

    def add(self, grams, counts) -> None:
        self.parts.append((grams, counts))
        self.waiting += len(grams)
        if self.waiting > max(self.held, ENTRIES_AT_ONCE // 2):
            self.merged()

    def merged(self):
        """(sorted distinct grams, counts)."""
        import numpy as np

        if len(self.parts) != 1 or self.waiting:
            grams = np.concatenate([np.zeros(0, np.uint64), *[g for g, _ in self.parts]])
            counts = np.concatenate([np.zeros(0, np.int64), *[c for _, c in self.parts]])
            self.parts = [summed(grams, counts)]
        self.waiting, self.held = 0, len(self.parts[0][0])
        return self.parts[0]


def summed(grams, counts):
    """(sorted distinct grams, their summed counts)."""
    import numpy as np

    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, np.int64)
    return grams[starts], np.add.reduceat(counts[order], starts) if len(grams) else np.zeros(0, np.int64)


def packed_bytes(grams) -> bytes:
    """Six bytes a gram, plane by plane: sorted grams then compress well."""
    import numpy as np

    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : ORDER + 1].T).tobytes()


def unpacked(held: bytes):
    import numpy as np

    planes = np.frombuffer(held, np.uint8).reshape(ORDER + 1, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : ORDER + 1] = planes.T
    return out.reshape(-1).view("<u8")


def shard_of(grams, shards: int):
    """Shard of each gram: by a hash of the last LOW context bytes."""
    import numpy as np

    context = (grams >> np.uint64(8)) & np.uint64((1 << 8 * LOW) - 1)
    return (((context * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)).astype(np.int16)


def gather(docs: DataFrame, shards: int, chunk: int = CHUNK, piece: int = PIECE) -> DataFrame:
    """Rows (chunk, shard, grams, counts) of the distinct grams of every chunk with their training counts, and rows (chunk, doc_id, held_out, text) of its documents.

    ``docs`` has doc_id, held_out, train and text (binary).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        number, tally, size, schema = TaskContext.get().partitionId() << 24, Tally(), 0, None

        def filled(rows: int, **columns) -> pa.RecordBatch:
            columns["chunk"] = pa.array([number] * rows, pa.int64())
            return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(rows, f.type) for f in schema], schema=schema)

        def closed() -> pa.RecordBatch:
            grams, counts = tally.merged()
            own = shard_of(grams, shards)
            order = np.argsort(own, kind="stable")
            grams, counts = grams[order], counts[order].astype("<u4")
            cuts = np.searchsorted(own[order], np.arange(shards + 1))
            there = np.flatnonzero(cuts[1:] > cuts[:-1]).tolist()
            spans = [slice(cuts[s], cuts[s + 1]) for s in there]
            return filled(len(there), shard=pa.array(there, pa.int32()), grams=pa.array([packed_bytes(grams[s]) for s in spans], pa.binary()), counts=pa.array([counts[s].tobytes() for s in spans], pa.binary()))

        for batch in batches:
            if schema is None:
                schema = pa.schema([("chunk", pa.int64()), ("shard", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()), ("doc_id", batch.schema.field(0).type), ("held_out", pa.bool_()), ("text", pa.binary())])
            yield filled(batch.num_rows, doc_id=batch.column(0), held_out=batch.column(1), text=batch.column(3))
            learned = batch.column(2).to_numpy(zero_copy_only=False)
            for learn in (True, False):
                chosen = (t for t, x in zip(batch.column(3), learned, strict=True) if x == learn)
                for parts in _in_batches((p for t in chosen for p in pieces(t.as_py().translate(LOWER_TABLE), piece)), piece):
                    grams, counts = np.unique(_grams(parts)[0], return_counts=True)
                    tally.add(grams, counts if learn else np.zeros(len(grams), np.int64))
            size += batch.column(3).nbytes
            if size >= chunk:
                yield closed()
                number, tally, size = number + 1, Tally(), 0
        if size or tally.parts:
            yield closed()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "train", "text").mapInArrow(run, f"chunk long, shard int, grams binary, counts binary, doc_id {kind}, held_out boolean, text binary")


def merge_counts(gathered: DataFrame, shards: int) -> DataFrame:
    """(shard, grams, counts): the trie's longest grams with their counts over all training documents, in blobs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def closed(shard: int, tally: Tally) -> Iterator[pa.RecordBatch]:
            grams, counts = tally.merged()
            for at in range(0, len(grams), ENTRIES_AT_ONCE):
                g, c = grams[at : at + ENTRIES_AT_ONCE], counts[at : at + ENTRIES_AT_ONCE]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([packed_bytes(g)], pa.binary()), pa.array([c.astype("<i8").tobytes()], pa.binary())], names=["shard", "grams", "counts"])

        last, tally = None, Tally()
        for batch in batches:
            for shard, grams, counts in zip(*(batch.column(i) for i in range(3)), strict=True):
                shard = shard.as_py()
                if last is not None and shard != last:
                    yield from closed(last, tally)
                    tally = Tally()
                last = shard
                g, c = unpacked(grams.as_py()), np.frombuffer(counts.as_py(), "<u4").astype(np.int64)
                tally.add(g[c > 0], c[c > 0])
        if last is not None:
            yield from closed(last, tally)

    rows = gathered.filter("shard is not null").select("shard", "grams", "counts")
    return rows.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, "shard int, grams binary, counts binary")


def low_grams(trie: DataFrame):
    """Arrays (gram, n) of the grams of LOW bytes, over all shards: at most 257^LOW."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally = Tally()
            for grams, counts in zip(batch.column(0), batch.column(1), strict=True):
                tally.add(*marginal(unpacked(grams.as_py()), np.frombuffer(counts.as_py(), "<i8"), LOW))
            grams, counts = tally.merged()
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(counts)], names=["gram", "n"])

    t = trie.select("grams", "counts").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy()


def marginal(grams, counts, size: int):
    """Counts of the last ``size`` bytes of grams."""
    import numpy as np

    return summed(grams & np.uint64((1 << 8 * size) - 1), counts)


class Index:
    """Place of keys in a sorted array: one probe of a hash table of at least twice its size, a binary search where two keys share a slot."""

    def __init__(self, keys) -> None:
        import numpy as np

        self.keys = keys
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys):
        import numpy as np

        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, wanted):
        """(place, whether it is there) of each wanted key."""
        import numpy as np

        if not len(self.keys):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = self.slots[self._slot(wanted)].astype(np.int64)
        hit = (self.keys[at] == wanted) & (at >= 0)
        other = np.flatnonzero(~hit & (at >= 0))
        if len(other):
            again = np.minimum(np.searchsorted(self.keys, wanted[other]), len(self.keys) - 1)
            at[other], hit[other] = again, self.keys[again] == wanted[other]
        return at, hit


@dataclass(frozen=True)
class Level:
    """The entries of one order, sorted, and its contexts with their totals, also those after exclusion in the suffix."""

    grams: Index
    n: object
    log_direct: object
    contexts: Index
    total: object
    distinct: object
    log_escape: object
    left: object
    fresh: object


def build_levels(grams, counts, sizes: range, below: list[Level]) -> list[Level]:
    """``below`` and the levels of ``sizes``, counted from grams of at least those sizes."""
    import numpy as np

    levels = list(below)
    for k in sizes:
        g, c = marginal(grams, counts, k)
        c = c.astype(np.float64)
        contexts, at = np.unique(g >> np.uint64(8), return_inverse=True)
        total, distinct = np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts)).astype(np.float64)
        if levels:
            under = levels[-1]
            own, _ = under.grams.find(g & np.uint64((1 << 8 * (k - 1)) - 1))
            excluded = np.bincount(at, under.n[own], len(contexts))
            parent, _ = under.contexts.find(contexts & np.uint64((1 << 8 * (k - 2)) - 1))
            left, fresh = under.total[parent] - excluded, under.distinct[parent] - distinct
        else:
            left, fresh = np.zeros(len(contexts)), 256 - distinct
        levels.append(Level(Index(g), c, np.log10(c / (total + distinct)[at]), Index(contexts), total, distinct, np.log10(distinct / (total + distinct)), left, fresh))
    return levels


def log_probabilities(levels: list[Level], packed):
    """log10 probability of each packed gram's last byte after its context."""
    import numpy as np

    out = np.zeros(len(packed))
    todo, child = np.arange(len(packed)), np.full(len(packed), -1)
    for k in range(ORDER + 1, 0, -1):
        level = levels[k - 1]
        g = packed[todo] & np.uint64((1 << 8 * k) - 1)
        at, hit = level.grams.find(g)
        direct = child < 0
        now = hit & direct
        out[todo[now]] += level.log_direct[at[now]]
        now = hit & ~direct
        if now.any():
            above = levels[k]
            c = child[now]
            out[todo[now]] += np.log10(level.n[at[now]] / (above.left[c] + above.fresh[c]))
        todo, child, g, direct = todo[~hit], child[~hit], g[~hit], direct[~hit]
        if not len(todo):
            return out
        at, seen = level.contexts.find(g >> np.uint64(8))
        now = seen & direct
        out[todo[now]] += level.log_escape[at[now]]
        now = ~direct
        if now.any():
            above = levels[k]
            left, fresh = above.left[child[now]], above.fresh[child[now]]
            out[todo[now]] += np.where(fresh > 0, np.log10(np.maximum(fresh, 1e-300) / np.maximum(left + fresh, 1e-300)), 0.0)
        child = np.where(seen, at, -1)
    rest = 256 - len(levels[0].grams.keys)
    out[todo] -= math.log10(max(1, rest))
    return out


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; the null word counts the documents, i.e. the end tokens."""

    def batch(seen: Counter, texts: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*seen, None], pa.binary()), pa.array([*seen.values(), texts], pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        texts = 0
        for t in _lowered(batches):
            seen.update(t.split())
            texts += 1
            if len(seen) > FLUSH:
                yield batch(seen, texts)
                seen, texts = Counter(), 0
        yield batch(seen, texts)

    return docs.select(text_of().cast("binary").alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def answers(gathered: DataFrame, trie: DataFrame, low, shards: int) -> DataFrame:
    """(chunk, grams, logs): the log10 probability of every distinct gram of every chunk. ``low`` is the broadcast of low_grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        base = build_levels(*low.value, range(1, LOW + 1), [])
        last, tally, levels = None, Tally(), None
        for batch in batches:
            chunks, blobs, logs = [], [], []
            for shard, chunk, grams, counts in zip(*(batch.column(i) for i in (0, 2, 3, 4)), strict=True):
                if shard.as_py() != last:
                    last, tally, levels = shard.as_py(), Tally(), None
                g = unpacked(grams.as_py())
                if not chunk.is_valid:
                    tally.add(g, np.frombuffer(counts.as_py(), "<i8"))
                    continue
                if levels is None:
                    levels = build_levels(*tally.merged(), range(LOW + 1, ORDER + 2), base)
                chunks.append(chunk.as_py())
                blobs.append(grams.as_py())
                logs.append(log_probabilities(levels, g).astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary()), pa.array(logs, pa.binary())], names=["chunk", "grams", "logs"])

    asked = gathered.filter("shard is not null").select("shard", F.lit(1).alias("kind"), "chunk", "grams", F.lit(None).cast("binary").alias("counts"))
    known = trie.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("chunk"), "grams", "counts")
    return known.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "chunk long, grams binary, logs binary")


class WordLogs:
    """Sums of the frequent words' logarithms, and the other words of a text."""

    def __init__(self, logs: dict[bytes, float], ends: int) -> None:
        self.logs, self.ends = logs, ends

    def of(self, text: bytes) -> tuple[int, int, float, Counter]:
        words = text.split()
        known = [self.logs[w] for w in words if w in self.logs]
        rare = Counter(w for w in words if w not in self.logs) if len(known) < len(words) else Counter()
        return len(words) + 1, len(known) + (self.ends > 0), math.fsum(known) + math.log10(self.ends + 1), rare


def score_chunks(gathered: DataFrame, answered: DataFrame, frequent, ends: int, parts: int, piece: int = SCORED_AT_ONCE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, logs, score, rare for every document."""

    def scored(texts: pa.Array, index: Index, logs, words: WordLogs) -> list[pa.Array]:
        import numpy as np

        tokens, known, sums, rare_words, times, ends_at = [], [], [], [], [], [0]
        values = np.zeros(len(texts))
        owners: list[int] = []

        def lowered() -> Iterator[bytes]:
            for i, t in enumerate(texts):
                text = t.as_py().translate(LOWER_TABLE)
                n, k, s, rare = words.of(text)
                tokens.append(n)
                known.append(k)
                sums.append(s)
                rare_words.extend(rare.keys())
                times.extend(rare.values())
                ends_at.append(len(rare_words))
                for p in pieces(text, piece):
                    owners.append(i)
                    yield p

        for parts in _in_batches(lowered(), piece):
            grams, starts = _grams(parts)
            at, hit = index.find(grams)
            if not hit.all():
                raise ValueError("a chunk lacks an answer")
            values += np.bincount(owners, np.add.reduceat(logs[at], starts), len(texts))
            owners.clear()
        pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(times, pa.int32())], names=["word", "times"])
        return [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(sums, pa.float64()), pa.array(values), pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pairs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        words = WordLogs(frequent.value, ends)
        last, blobs, index, logs = None, [], None, None
        for batch in batches:
            chunks, answer = batch.column(0).to_numpy(), batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((chunks[1:] != chunks[:-1]) | (answer[1:] != answer[:-1])) + 1).tolist(), len(chunks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if chunks[a] != last:
                    last, blobs, index = chunks[a], [], None
                if answer[a]:
                    blobs.extend((unpacked(g.as_py()), np.frombuffer(v.as_py(), "<f8")) for g, v in zip(batch.column(4)[a:b], batch.column(5)[a:b], strict=True))
                    continue
                if index is None:
                    grams, logs = (np.concatenate(x) for x in zip(*blobs, strict=True))
                    order = np.argsort(grams)
                    index, logs, blobs = Index(grams[order]), logs[order], []
                names = ["doc_id", "held_out", "n_tokens", "n_known", "logs", "score", "rare"]
                yield pa.RecordBatch.from_arrays([batch.column(1)[a:b], batch.column(2)[a:b], *scored(batch.column(3)[a:b], index, logs, words)], names=names)

    texts = gathered.filter("shard is null").select("chunk", "doc_id", "held_out", "text", F.lit(None).cast("binary").alias("grams"), F.lit(None).cast("binary").alias("logs"))
    both = answered.unionByName(texts, allowMissingColumns=True).select("chunk", "doc_id", "held_out", "text", "grams", "logs")
    kind = gathered.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, logs double, score double, rare array<struct<word:binary,times:int>>"
    return both.repartition(parts, "chunk").sortWithinPartitions("chunk", F.col("grams").isNull()).mapInArrow(run, schema)


def score_documents(docs: DataFrame, training: Column | None = None, frequent: int = FREQUENT, chunk: int = CHUNK, shard: int = SHARD, piece: int = PIECE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    ``training`` says which rows are learned from (default: those not held out).
    """
    sc = docs.sparkSession.sparkContext
    train = F.coalesce(~held_out() if training is None else training, F.lit(False))
    counts = staged(count_words(docs.filter(train)), "words")
    total, distinct, ends = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("word"), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))).first()
    words = counts.filter("word is not null")
    steps = sorted(((r[0], r[1]) for r in words.groupBy("n").count().collect()), reverse=True)
    least, kept = None, 0
    for n, c in steps:
        if kept + c > frequent:
            break
        least, kept = n, kept + c
    common = {} if least is None else {bytes(r[0]): math.log10(r[1] + 1) for r in words.filter(F.col("n") >= least).toLocalIterator()}
    whole = docs.select("doc_id", held_out().alias("held_out"), train.alias("train"), text_of().cast("binary").alias("text"))
    size = whole.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MOST_SHARDS, max(4, size // shard))
    gathered = staged(gather(whole, shards, chunk, piece), "chunks")
    trie = staged(merge_counts(gathered, shards), "trie")
    answered = answers(gathered, trie, sc.broadcast(low_grams(trie)), shards)
    # About two partitions a chunk, so that few tasks get several.
    scored = score_chunks(gathered, answered, sc.broadcast(common), ends, max(8, 2 * size // chunk), min(piece, SCORED_AT_ONCE))
    scored = staged(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    discard(gathered, trie)
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    others = words if least is None else words.filter(F.col("n") < least)
    sums = rare.join(others, "word").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    bottom = math.log10(total + distinct + (ends > 0) + 1)
    return scored.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(bottom)).alias("base_score"),
        "score",
    )
