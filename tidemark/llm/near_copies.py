"""Near copies by SimHash (simhash.py), and by shingle similarity where fingerprints lie too far apart.

Two texts are near copies if the SimHash operator links their fingerprints, or if their sets of word
shingles (by XXH64) have a Jaccard similarity of SIMILARITY or more. The operator runs as it is: tiles,
population counts, components. Its 64 bits bound no similarity (of the 48 pairs at 0.8 or more at sf0.1, 4
lie within its 4 bits), so the similar pairs are found as well; the links of both make one graph.

For the second kind each text gets BANDS x ROWS minima of its distinct shingle hashes under as many
orders. A band of ROWS minima names a bucket, so only texts that are alike meet and the work grows
with the documents, not with their square; buckets of equal members are compared once. A bucket is
compared in tiles ordered by set size: tile pairs whose sizes are too far apart are skipped,
exclusive-or and bit counts of parity fingerprints leave the pairs that can be near, and of those the
ones not yet joined are counted shingle by shingle.

Measures: a pair at exactly 0.8 shares a bucket with probability 0.997. Nothing else loses a pair: a
parity bit differs only if some shingle is in one text alone, so a fingerprint distance never exceeds
the number of such shingles, and a pair is skipped only where that number must be too large. Nothing
is capped: a bucket too large for one task, by texts or by bytes, is dealt to several, pair of parts by
pair of parts, and a task returns a spanning forest of its links.

Texts of equal shingle sets are one class before any comparison. Defined cases: texts without words
are one class; fewer words than a shingle are one shingle; null doc_ids are the smallest of a class
only among themselves; repeated rows share a class and are all kept or all dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import staged, text_of, with_hot_keys_salted
from tidemark.llm.simhash import BUCKET, TILE, component_ids, components, fingerprint, shingle_hashes
from tidemark.llm.simhash import SHINGLE as PRINT_SHINGLE

SIMILARITY = 0.8
SHINGLE = 5
#: Bits of a parity fingerprint.
PARITY = 1024
BANDS = 15
ROWS = 5
#: Bytes of shingle sets in one part of a bucket.
PART_BYTES = 16 << 20
#: Up to so many candidate texts their ids are broadcast to pick their shingle sets, else both sides are shuffled.
BROADCAST_NODES = 2_000_000


def _multipliers():
    """Odd 64-bit factors, each a different order of the hashes."""
    import numpy as np

    return np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(text: bytes, k: int, factors) -> tuple[int, bytes, list[int]]:
    """Class, shingle set (sorted 64-bit hashes) and band buckets of a text."""
    import numpy as np
    import xxhash

    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    parts = [np.unique(hashes) for hashes in shingle_hashes(text, k)]
    distinct = parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))
    for at in range(0, len(distinct), 1024):
        np.minimum(least, (distinct[at : at + 1024, None] * factors).min(axis=0), out=least)
    bands = [xxhash.xxh64_intdigest(least[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    held = distinct.astype("<u8").tobytes()
    return xxhash.xxh64_intdigest(held, 42), held, bands


def signature_udf(k: int = SHINGLE, prints: int = 0):
    """Column function: binary text -> struct(node, shingles, bands, fp); fp is the fingerprint over shingles of ``prints`` words, 0 without."""

    @F.arrow_udf("struct<node:bigint,shingles:binary,bands:array<bigint>,fp:bigint>")
    def signatures(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        factors = _multipliers()
        for texts in batches:
            made, found = [], []
            for t in texts:
                text = t.as_py()
                made.append(signature(text, k, factors))
                found.append(fingerprint(text, prints) if prints else 0)
            nodes = pa.array(np.array([m[0] for m in made], np.uint64).view(np.int64))
            bands = pa.array(np.array([b for m in made for b in m[2]], np.uint64).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(made) + 1) * BANDS, BANDS, dtype=np.int32)), bands)
            fps = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.StructArray.from_arrays([nodes, pa.array([m[1] for m in made], pa.binary()), lists, fps], names=["node", "shingles", "bands", "fp"])

    return signatures


def estimate(a, b):
    """Jaccard similarity of the shingle sets (rows of bytes) of two lists, pair by pair. It is exact."""
    import numpy as np

    out = []
    for x, y in zip(a, b, strict=True):
        x, y = (np.ascontiguousarray(v).view("<u8") for v in (x, y))
        common = len(np.intersect1d(x, y, assume_unique=True))
        out.append(common / (len(x) + len(y) - common) if len(x) or len(y) else 1.0)
    return np.array(out)


def parities(values, starts, ends):
    """Rows of PARITY bits (as uint64): is the number of a set's hashes that fall to a bit odd?"""
    import numpy as np

    out = np.zeros((len(starts), PARITY // 64), np.uint64)
    for at in range(0, len(starts), TILE):
        low, sizes = starts[at : at + TILE], (ends - starts)[at : at + TILE]
        row = np.repeat(np.arange(len(low)), sizes)
        held = values[low[0] : low[0] + len(row)]
        odd = np.bincount(row * PARITY + (held % np.uint64(PARITY)).astype(np.int64), minlength=len(low) * PARITY) & 1
        out[at : at + TILE] = np.packbits(odd.astype(bool).reshape(len(low), PARITY), axis=1).view(np.uint64)
    return out


def forest(nodes, shingles: list[bytes], sides, similarity: float) -> list[tuple[int, int]]:
    """Spanning forest of the near copies of a bucket: all its texts, or those of side 0 with those of side 1."""
    import numpy as np

    sizes = np.array([len(s) // 8 for s in shingles], np.int64)
    order = np.lexsort((nodes, sizes))
    nodes, sides, sizes = nodes[order], sides[order], sizes[order]
    values = np.frombuffer(b"".join([shingles[i] for i in order.tolist()]), "<u8")
    ends = np.cumsum(sizes)
    starts = ends - sizes
    prints = parities(values, starts, ends)
    known, ids = np.unique(values, return_inverse=True)
    mark = np.zeros(len(known), bool)
    most = (1 - similarity) / (1 + similarity)
    group = np.arange(len(nodes))
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    crossed = len(right) > 0
    if not crossed:
        right = left
    edges = []
    for i in range(0, len(left), TILE):
        a = left[i : i + TILE]
        for j in range(0 if crossed else i, len(right), TILE):
            b = right[j : j + TILE]
            if sizes[b[0]] * similarity > sizes[a[-1]] + 1e-6 or sizes[a[0]] * similarity > sizes[b[-1]] + 1e-6:
                continue
            for s in a.tolist():
                other = b[group[b] != group[s]] if crossed else b[(b > s) & (group[b] != group[s])]
                other = other[(sizes[other] * similarity <= sizes[s] + 1e-6) & (sizes[s] * similarity <= sizes[other] + 1e-6)]
                apart = np.bitwise_count(prints[other] ^ prints[s]).sum(axis=1, dtype=np.int64)
                other = other[apart <= most * (sizes[other] + sizes[s]) + 1e-6]
                if not len(other):
                    continue
                own = ids[starts[s] : ends[s]]
                mark[own] = True
                stops = np.cumsum(sizes[other])
                at = np.repeat(starts[other] - (stops - sizes[other]), sizes[other]) + np.arange(stops[-1])
                seen = np.concatenate(([0], np.cumsum(mark[ids[at]])))
                mark[own] = False
                common = seen[stops] - seen[stops - sizes[other]]
                alike = other[common / np.maximum(sizes[other] + sizes[s] - common, 1) >= similarity]
                met, first = np.unique(group[alike], return_index=True)
                edges.extend((int(nodes[s]), int(nodes[t])) for t in alike[first].tolist())
                group[np.isin(group, met)] = group[s]
    return edges


def _compare(similarity: float):
    """mapInArrow function over rows (task, side, node, shingles) sorted by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def compared(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = pa.Table.from_batches(parts)
            if len(held) > 1:
                column = lambda n: held.column(n).to_numpy()
                edges = forest(column("node"), held.column("shingles").to_pylist(), column("side"), similarity)
                if edges:
                    yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

        last, held = None, []
        for batch in batches:
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s == e:
                    continue
                if held and keys[s] != last:
                    yield from compared(held)
                    held = []
                last = keys[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield from compared(held)

    return run


def links(classes: DataFrame, signed: DataFrame, similarity: float, bucket: int) -> DataFrame:
    """Edges (a, b) that span the near copies among ``classes(node, n, bands)``; ``signed`` has the shingles of each node."""
    keys = classes.select("node", "n", F.explode("bands").alias("bucket"))
    members = [F.bit_xor(F.xxhash64(F.lit(x), "node")).alias(f"m{x}") for x in (1, 2)]
    sizes = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("held"), *members).filter("size > 1")
    sizes = sizes.groupBy("size", "m1", "m2").agg(F.min("bucket").alias("bucket"), F.first("held").alias("held"))
    parts = F.greatest(F.ceil(F.col("size") / F.lit(bucket)), F.ceil(F.col("held") * 8 / F.lit(PART_BYTES))).cast("int")
    met = keys.join(sizes.select("bucket", parts.alias("parts")), "bucket")
    part = F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
    dealt = staged(
        met.withColumn("part", part).select("bucket", "node", "part", F.explode(pairs).alias("p"))
        .select(F.xxhash64("bucket", "p.i", "p.j").alias("task"), F.when((F.col("p.i") != F.col("p.j")) & (F.col("part") == F.col("p.j")), 1).otherwise(0).alias("side"), "node"),
        "dealt",
    )
    wanted = dealt.select("node").distinct()
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    sets = signed.select("node", "shingles").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    full = dealt.join(sets, "node").select("task", "side", "node", "shingles")
    return full.repartition("task").sortWithinPartitions("task").mapInArrow(_compare(similarity), "a long, b long")


def print_links(signed: DataFrame, radius: int, bucket: int, rows: int) -> DataFrame:
    """Edges (a, b) from each node of ``signed(node, fp)`` to the smallest node of its fingerprint's component, by the SimHash operator."""
    prints = signed.select("node", "fp")
    ids = component_ids(prints.select(F.col("node").alias("doc_id"), "fp"), radius, bucket)
    met = with_hot_keys_salted(prints, ids, "fp", rows)
    return staged(met.select(F.col("node").alias("a"), F.col("component_id").alias("b")).filter("a <> b").distinct(), "print-links")


def near_copies(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, bucket: int = BUCKET, radius: int | None = None) -> DataFrame:
    """doc_id, text_hash (of the text as it is), component_id (the smallest doc_id its near copies reach) and kept for every row.

    ``kept`` holds for one document (doc_id, text) of each component, one with the smallest doc_id. With a ``radius`` fingerprints
    within so many bits link as well.
    """
    made = docs.select("doc_id", F.xxhash64(text_of()).alias("text_hash"), signature_udf(k, 0 if radius is None else PRINT_SHINGLE)(text_of().cast("binary")).alias("s"))
    signed = staged(made.select("doc_id", "text_hash", "s.*", (F.octet_length("s.shingles") / 8).cast("long").alias("n")), "signatures")
    rows = signed.count()
    edges = links(signed.groupBy("node").agg(F.first("n").alias("n"), F.first("bands").alias("bands")), signed, similarity, bucket)
    roots = components(edges if radius is None else print_links(signed, radius, bucket, rows).unionAll(edges))
    document = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    members = signed.groupBy("node").agg(F.min(document).alias("own"))
    linked = members.join(roots, "node").select("node", "own", "root")
    smallest = linked.groupBy("root").agg(F.min("own").alias("smallest"))
    named = members.join(with_hot_keys_salted(linked, smallest, "root", rows).select("node", "smallest"), "node", "left").select("node", F.coalesce("smallest", "own").alias("keeper"))
    kept = F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_hash") == F.col("keeper.text_hash"))
    return with_hot_keys_salted(signed.select("doc_id", "text_hash", "node"), named, "node", rows).select("doc_id", "text_hash", F.col("keeper.doc_id").alias("component_id"), kept.alias("kept"))
