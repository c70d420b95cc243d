"""Approximate nearest neighbours by randomly rotated one-bit codes.

Index. Every vector is centred on the mean of all vectors and scaled to unit length, o. A random rotation P
turns it; the signs of the rotated entries are its code, packed into 64-bit words, which stands for the unit
vector s / sqrt(D) with s in {-1, 1}^D. Kept with the code are the length of the centred vector and the
correction scalar c = <s / sqrt(D), P o>.

Search. For a query, centred, scaled and rotated likewise to u, <s / sqrt(D), u> / c estimates the inner product
of the two unit vectors without bias. It comes from the packed bits alone: u is cut into LEVELS bit planes, and
the sum over set bits is a weighted sum of bit counts of code AND plane. The error is at most
MARGIN * sqrt(1 - c^2) / (c * sqrt(D - 1)), save with the probability of MARGIN deviations of a Gaussian, plus
what the planes round off, which is computed. So each vector has a lower bound of its distance. The k-th smallest
true distance among the vectors of the best estimates is a limit; every vector whose lower bound is within
the limit is reranked by its true distance, however many these are. A vector is missed only where its bound failed.

Layout. Vectors are dealt to blocks of bounded size by a hash of the row, so that copies and common vectors spread
evenly. Queries stream through every block after its vectors, and leave their k best of the block; a window over
queries keeps the best k of all. Nothing but the mean and the rotation's seed goes through the driver.

Defined cases: rows without an id, without a vector, or with a vector that is zero, has null or non-finite entries, or
another length than most, take no part; rows that repeat both id and vector are one row; rows that share an id and differ
in their vectors are different rows, each a query and a candidate of the other; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, staged
from tidemark.llm.vectors import ID, VECTOR, matrix, sound_vectors

NEAREST = 10
EVERY = 100
SEED = 20_240_601
#: Deviations of the estimate that the error bound covers.
MARGIN = 3.0
LEVELS = 8
#: Bytes of a block's vectors as doubles, and of the least block.
BLOCK_BYTES, LEAST_BYTES = 32 << 20, 1 << 20


@lru_cache(2)
def rotation(d: int, seed: int):
    """A random orthogonal matrix."""
    import numpy as np

    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def _unit(rows, centre):
    import numpy as np

    moved = rows - centre
    norm = np.sqrt((moved * moved).sum(axis=1))
    return moved / np.where(norm > 0, norm, 1.0)[:, None], norm


def _packed(bits):
    """Rows of booleans as rows of 64-bit words."""
    import numpy as np

    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("<u8")


def encode(rows, centre, seed: int):
    """Codes (rows of words), lengths and correction scalars of vectors."""
    import numpy as np

    unit, norm = _unit(rows, centre)
    turned = unit @ rotation(rows.shape[1], seed)
    correction = np.abs(turned).sum(axis=1) / np.sqrt(rows.shape[1])
    return _packed(turned > 0), norm, np.where(norm > 0, correction, 1.0)


def distances(rows, query):
    """Euclidean distances, squares summed entry by entry in order."""
    import numpy as np

    total = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        step = rows[:, j] - query[j]
        total += step * step
    return np.sqrt(total)


class Block:
    """Vectors of a block with their codes."""

    def __init__(self, ids, rows, words, norm, correction, centre, seed: int, margin: float) -> None:
        import numpy as np

        order = np.argsort(ids, kind="stable")
        again = set(ids[order][1:][ids[order][1:] == ids[order][:-1]].tolist())
        if again:  # of rows that repeat both id and vector the first stays
            seen = set()
            whole = [(int(ids[i]), rows[i].tobytes()) if ids[i] in again else None for i in order]
            order = np.array([i for i, key in zip(order, whole, strict=True) if key is None or not (key in seen or seen.add(key))], np.int64)
        self.ids, self.rows, self.words, self.norm, self.correction = ids[order], rows[order], words[order], norm[order], correction[order]
        self.centre, self.seed = centre, seed
        d = rows.shape[1]
        self.ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        self.slack = margin * np.sqrt(np.maximum(0.0, 1.0 - self.correction**2)) / (self.correction * np.sqrt(max(d - 1, 1)))

    def search(self, ids, queries, k: int) -> Iterator[tuple]:
        """(query, ids, distances) of the k best of each query, nearest first."""
        import numpy as np

        d = queries.shape[1]
        unit, norm = _unit(queries, self.centre)
        for q, (own, turned, length) in enumerate(zip(ids.tolist(), unit @ rotation(d, self.seed), norm.tolist(), strict=True)):
            low = turned.min()
            step = (turned.max() - low) / ((1 << LEVELS) - 1) or 1.0
            cut = np.rint((turned - low) / step).astype(np.int64)
            planes = _packed(((cut[None, :] >> np.arange(LEVELS)[:, None]) & 1).astype(bool))
            over = np.zeros(len(self.ids), np.int64)
            for j in range(LEVELS):
                over += np.bitwise_count(self.words & planes[j]).sum(axis=1, dtype=np.int64) << j
            dot = (2.0 * (low * self.ones + step * over) - (low * d + step * cut.sum())) / np.sqrt(d)
            guess = dot / self.correction
            off = self.slack + np.abs(turned - (low + step * cut)).sum() / np.sqrt(d) / self.correction
            around = self.norm**2 + length**2
            reach = 2.0 * self.norm * length
            same = np.flatnonzero(self.ids == own)
            apart = np.ones(len(self.ids), bool)
            apart[[i for i in same if np.array_equal(self.rows[i], queries[q])]] = False
            there = np.flatnonzero(apart)
            if not len(there):
                continue
            limit = np.inf
            if len(there) > 4 * k:
                first = there[np.argpartition((around - reach * guess)[there], 4 * k)[: 4 * k]]
                limit = np.partition(distances(self.rows[first], queries[q]), k - 1)[k - 1]
            bound = around - reach * np.minimum(1.0, guess + off)
            picked = there[bound[there] <= limit * limit * (1 + 1e-9) + 1e-12 * around[there]]
            far = distances(self.rows[picked], queries[q])
            best = np.lexsort((self.ids[picked], far))[:k]
            yield q, self.ids[picked][best], far[best]


def build_index(vectors: DataFrame, d: int, centre: list[float], seed: int = SEED) -> DataFrame:
    """``vectors`` (id, v) with code, norm and correction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        at = np.array(centre)
        for batch in batches:
            words, norm, correction = encode(matrix(batch.column(1), d), at, seed)
            code = pa.array([w.tobytes() for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, code, pa.array(norm), pa.array(correction)], names=["id", "v", "code", "norm", "correction"])

    return vectors.mapInArrow(run, f"id long, v {dict(vectors.dtypes)['v']}, code binary, norm double, correction double")


def mean_vector(vectors: DataFrame, d: int) -> list[float]:
    """The mean of all vectors, summed in each task before the sums meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total, n = np.zeros(d), 0
        for batch in batches:
            total += matrix(batch.column(0), d).sum(axis=0)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(total), pa.array([n] * d, pa.int64())], names=["j", "total", "n"])

    sums = vectors.select("v").mapInArrow(run, "j int, total double, n long").groupBy("j").agg((F.sum("total") / F.sum("n")).alias("mean"))
    mean = dict(sums.collect())
    return [mean[j] for j in range(d)] if mean else [0.0] * d


def _searching(d: int, k: int, centre: list[float], seed: int, margin: float):
    """mapInArrow function over rows (block, side, id, v, code, norm, correction) sorted by block and side: vectors, then queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        at = np.array(centre)
        last, held, block = None, [], None
        for batch in batches:
            blocks, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (sides[1:] != sides[:-1])) + 1).tolist(), len(blocks)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if blocks[s] != last:
                    last, held, block = blocks[s], [], None
                part = batch.slice(s, e - s)
                ids, rows = part.column(2).to_numpy(), matrix(part.column(3), d)
                if not sides[s]:
                    words = np.frombuffer(b"".join(part.column(4).to_pylist()), "<u8").reshape(e - s, -1)
                    held.append((ids, rows, words, part.column(5).to_numpy(), part.column(6).to_numpy()))
                    continue
                if not held and block is None:
                    continue
                if block is None:
                    block, held = Block(*map(np.concatenate, zip(*held, strict=True)), at, seed, margin), []
                found = list(block.search(ids, rows, k))
                if found:
                    sizes = [len(i) for _, i, _ in found]
                    marks = part.column(7).to_numpy()
                    own = np.array([q for q, _, _ in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(ids[own], sizes)), pa.array(np.repeat(marks[own], sizes)), pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([x for _, _, x in found]))],
                        names=["query_id", "mark", "vec_id", "score"],
                    )

    return run


def nearest(table: DataFrame, queries: Column | None = None, k: int = NEAREST, id: str = ID, vector: str = VECTOR, seed: int = SEED, margin: float = MARGIN) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows of the rows that ``queries`` (a condition on ``id``) chooses.

    Without ``queries``, those whose id EVERY divides.
    """
    vectors, d, n = sound_vectors(table.filter(F.col(id).isNotNull()).withColumn(id, F.col(id).cast("long")), id, vector, zero=False)
    spark = table.sparkSession
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = F.col("id") % EVERY == 0 if queries is None else queries
    centre = mean_vector(vectors, d)
    index = staged(build_index(vectors, d, centre, seed), "codes")
    least = min(spark.sparkContext.defaultParallelism, -(-n * d * 8 // LEAST_BYTES))
    blocks = max(1, least, -(-n * d * 8 // BLOCK_BYTES))
    mark = F.xxhash64("id", "v")
    rows = index.select(F.pmod(mark, F.lit(blocks)).cast("int").alias("block"), F.lit(0).cast("int").alias("side"), "id", "v", "code", "norm", "correction", F.lit(0).cast("long").alias("mark"))
    asked = index.filter(chosen).select("id", "v").dropDuplicates(["id", "v"])
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asked = asked.select(everywhere.alias("block"), F.lit(1).alias("side"), "id", "v", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("norm"), F.lit(1.0).alias("correction"), mark.alias("mark"))
    both = rows.unionAll(asked).repartition(blocks, "block").sortWithinPartitions("block", "side")
    found = staged(both.mapInArrow(_searching(d, k, centre, seed, margin), "query_id long, mark long, vec_id long, score double"), "found")
    discard(index)
    order = Window.partitionBy("query_id", "mark").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
