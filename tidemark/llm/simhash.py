"""SimHash near-duplicates by tiled exact comparison.

A fingerprint bit is 1 if it is set in more than half of the XXH64 hashes of a text's word shingles.
Distinct fingerprints within ``radius`` bits are linked, exactly: of ``radius + agree`` bit blocks two
such fingerprints share at least ``agree``, so each choice of that many blocks has its values as buckets,
which are compared on their own. The more fingerprints there are, the more blocks must agree, so that
buckets stay small; every choice finds every link. Inside a bucket fingerprints are ordered by population count and cut into tiles; tile pairs whose
counts lie further apart than the radius are skipped, the others are compared by numpy exclusive-or
and bit counts. A bucket too large for one task is dealt to several, tile pair by tile pair. Each
comparison task keeps a union-find, so it returns a spanning forest of its links (fewer edges than
fingerprints), never all pairs of a group.

Copies share a fingerprint and are collapsed before any comparison; connected components come from
alternating star contraction, checkpointed into the shared folder.

Defined cases: null, empty and blank texts have no shingle and fingerprint zero, which links like any
other; fewer words than a shingle are one shingle; the component of documents that all lack an id is
null, else ids rule over null; repeated rows share a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import LOWER_TABLE, discard, staged, text_of, with_hot_keys_salted

RADIUS = 4
SHINGLE = 4
#: Fingerprints of a tile, and of a bucket that one task compares alone.
TILE = 2048
BUCKET = 16_384
HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, k: int) -> Iterator:
    """Arrays (uint64) of the XXH64 hashes of a text's word shingles, repeats included, at most HASHES_AT_ONCE each."""
    import numpy as np
    import xxhash

    words = text.translate(LOWER_TABLE).split()
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if words and len(words) <= k:
        yield np.array([digest(joined, 42)], np.uint64)
    elif words:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[: len(words) - k] + 1)).tolist()
        stops = ends[k - 1 :].tolist()
        for at in range(0, len(starts), HASHES_AT_ONCE):
            yield np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + HASHES_AT_ONCE], stops[at : at + HASHES_AT_ONCE], strict=True)], np.uint64)


class BitVotes:
    """Counts of set bits over arrays of hashes; a fingerprint bit is 1 if set in over half of them."""

    def __init__(self) -> None:
        import numpy as np

        self.ones, self.total = np.zeros(64, np.int64), 0

    def add(self, hashes) -> None:
        import numpy as np

        self.ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        self.total += len(hashes)

    def fingerprint(self) -> int:
        import numpy as np

        return int(np.packbits(self.ones * 2 > self.total, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, k: int) -> int:
    votes = BitVotes()
    for hashes in shingle_hashes(text, k):
        votes.add(hashes)
    return votes.fingerprint()


def fingerprint_udf(k: int = SHINGLE):
    """Column function: binary text -> fingerprint as a signed long."""

    @F.arrow_udf("bigint")
    def fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), k) for t in texts], np.uint64).view(np.int64))

    return fingerprints


def bucket_masks(radius: int, agree: int) -> list[int]:
    """Masks of every choice of ``agree`` out of radius + agree blocks that cut the 64 bits as evenly as may be."""
    n, blocks, at = radius + agree, [], 0
    for i in range(n):
        width = 64 // n + (i < 64 % n)
        blocks.append(((1 << width) - 1) << at)
        at += width
    return [sum(chosen) for chosen in combinations(blocks, agree)]


def agreeing(n: int, radius: int, held: int = 64) -> int:
    """The fewest blocks that must agree for ``n`` evenly spread fingerprints to fill buckets with at most ``held``."""
    for agree in range(1, 5):
        if n <= held << (64 * agree // (radius + agree)):
            return agree
    return 4


def _forest(prints, radius: int, cross=None) -> list[tuple[int, int]]:
    """Spanning forest of the links among fingerprints (uint64, sorted by population count), or between two such lists."""
    import numpy as np

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    edges = []
    left, right = prints, prints if cross is None else cross
    lc, rc = np.bitwise_count(left).astype(np.int16), np.bitwise_count(right).astype(np.int16)
    for i in range(0, len(left), TILE):
        a, ac = left[i : i + TILE], lc[i : i + TILE]
        for j in range(i if cross is None else 0, len(right), TILE):
            b, bc = right[j : j + TILE], rc[j : j + TILE]
            if bc[0] > ac[-1] + radius or ac[0] > bc[-1] + radius:
                continue
            for r in range(0, len(a), 128):
                near = np.bitwise_count(a[r : r + 128, None] ^ b[None, :]) <= radius
                x, y = np.nonzero(near)
                for p, q in zip(a[x + r].tolist(), b[y].tolist(), strict=True):
                    if p != q and (s := root(p)) != (t := root(q)):
                        parent[max(s, t)] = min(s, t)
                        edges.append((p, q))
    return edges


def _compare(radius: int):
    """mapInArrow function over rows (bucket, side, fp) sorted by them: a bucket is compared as a whole, or side 0 against side 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def compared(parts: list):
            sides = np.concatenate([s for s, _ in parts])
            prints = np.concatenate([p for _, p in parts])
            order = lambda v: v[np.argsort(np.bitwise_count(v), kind="stable")]
            a, b = order(prints[sides == 0]), order(prints[sides == 1])
            edges = _forest(a, radius, b) if len(b) else _forest(a, radius)
            if edges:
                e = np.array(edges, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

        last, held = None, []
        for batch in batches:
            keys, sides = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            prints = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if held and keys[s] != last:
                    if sum(len(p) for _, p in held) > 1:
                        yield from compared(held)
                    held = []
                last = keys[s]
                held.append((sides[s:e], prints[s:e]))
        if held:
            yield from compared(held)

    return run


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, agree: int = 1) -> DataFrame:
    """Edges (a, b) among distinct fingerprints ``prints(fp)`` that span every component of the exact radius graph."""
    signed = [m - (1 << 64) if m >> 63 else m for m in bucket_masks(radius, agree)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)])
    rows = prints.select("fp", F.explode(keys).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    counted = rows.join(sizes, "bucket").withColumn("parts", F.ceil(F.col("size") / F.lit(bucket)).cast("int"))
    part = F.pmod(F.xxhash64(F.lit("part"), "fp"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
    dealt = (
        counted.withColumn("part", part).select("bucket", "fp", "part", F.explode(pairs).alias("p"))
        .select(F.xxhash64("bucket", "p.i", "p.j").alias("task"), F.when((F.col("p.i") != F.col("p.j")) & (F.col("part") == F.col("p.j")), 1).otherwise(0).alias("side"), "fp")
    )
    return dealt.repartition("task").sortWithinPartitions("task").mapInArrow(_compare(radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node of its component.

    Large-star and small-star steps alternate until no edge changes; each round is written to the shared folder.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark, seen = None, (now.count(), None)
    while seen != mark:
        mark, before = seen, now
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = with_hot_keys_salted(both.filter("v > u"), least, "u", mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        pair = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = with_hot_keys_salted(large, down, "u", mark[0]).select(F.explode(pair).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        now = staged(small, "edges")
        discard(before)
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def component_ids(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, agree: int | None = None) -> DataFrame:
    """(fp, component_id) of every fingerprint of ``prints(doc_id, fp)``."""
    owners = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("own")), "owners")
    n = owners.count()
    roots = components(links(owners.select("fp"), radius, bucket, agree or agreeing(n, radius)))
    rooted = owners.join(roots, owners["fp"] == roots["node"], "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("own").alias("component_id"))
    return with_hot_keys_salted(rooted, smallest, "root", n).select("fp", "component_id")


def near_dedup(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row."""
    prints = staged(docs.select("doc_id", fingerprint_udf(k)(text_of().cast("binary")).alias("fp")), "fingerprints")
    ids = component_ids(prints, radius, bucket)
    joined = with_hot_keys_salted(prints, ids, "fp", prints.count())
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
