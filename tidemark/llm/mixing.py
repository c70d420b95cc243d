"""Mixing sources to target weights by Pfair scheduling.

A source with target weight w cuts its documents into blocks; block k (from 0) may not be placed
before slot floor(k/w) and must be placed before slot ceil((k+1)/w). Earliest deadline first over the
released blocks meets every deadline as the weights sum to 1, so over any prefix of slots a source is
less than one block away from its share. Weights are exact: whole numbers over their sum, not rounded
to a period, so nothing drifts however many slots there are.

Slots are computed in Spark, a range of slots a task. What has been placed before a range follows from
the weights alone: all blocks due by then and, of the next block of each source, the most urgent ones
that fit, i.e. that leave in every run of slots up to the range at most as many blocks as slots (a block
that is passed over found each slot since its release taken by more urgent ones). A task looks back no
further than the release of those blocks.

Blocks are numbered without a global sort: documents of a source go by hash into cells, cells are
counted with map-side combining, and a document's number is its rank in its cell plus the sizes of
the cells before. A cell gets the slots of its blocks, so documents move once.
When a source runs out its later slots stay empty; no document is dropped or repeated.

Defined cases: a null source is a source of its own; sources without a weight get the default; a
weight must be above zero, or its blocks would have no slot; an empty table gives an empty result; repeated rows are mixed as different documents.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import text_of

BLOCK = 8
#: Slots of a range at least.
PERIOD = 1000
#: Documents to a cell, and cells at least.
CELL = 4096
CELLS = 256


def shares(weights: list[float], period: int) -> list[int]:
    """Whole numbers of period-ths, at least one each, that sum to the period (largest remainders)."""
    total = sum(weights)
    ideal = [w / total * period for w in weights]
    parts = [max(1, math.floor(x)) for x in ideal]
    while sum(parts) > period:
        i = max(range(len(parts)), key=lambda k: (parts[k] - ideal[k] if parts[k] > 1 else -math.inf, -k))
        parts[i] -= 1
    for i in sorted(range(len(parts)), key=lambda k: (parts[k] - ideal[k], k))[: period - sum(parts)]:
        parts[i] += 1
    while sum(parts) < period:
        parts[max(range(len(parts)), key=lambda k: (ideal[k] - parts[k], -k))] += 1
    return parts


def exact_shares(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportion of the weights."""
    if not all(0 < w < math.inf for w in weights):
        raise ValueError("weights must be above zero and finite")
    ratios = [Fraction(w) for w in weights]
    scale = math.lcm(*[r.denominator for r in ratios])
    parts = [int(r * scale) for r in ratios]
    common = math.gcd(*parts)
    return [p // common for p in parts]


def placed_before(parts: list[int], start: int) -> list[int]:
    """How many blocks of each source earliest deadline first has placed in the slots before ``start``."""
    import numpy as np

    whole = sum(parts)
    placed = [p * start // whole for p in parts]
    left = start - sum(placed)
    if not left:
        return placed
    offered = [s for s, p in enumerate(parts) if placed[s] * whole // p < start]
    release = {s: placed[s] * whole // parts[s] for s in offered}
    first = min(release.values())
    due = [k * whole // p - first for s, p in enumerate(parts) for k in range(-(-first * p // whole), placed[s])]
    # room[i]: slots from first + i up to start that the blocks due by then leave free
    room = np.cumsum(1 - np.bincount(np.array(due, np.int64), minlength=start - first)[::-1])[::-1]
    for s in sorted(offered, key=lambda s: (-(-(placed[s] + 1) * whole // parts[s]), -parts[s], s)):
        if not left:
            break
        held = room[: release[s] - first + 1]
        if held.min() > 0:
            held -= 1
            placed[s] += 1
            left -= 1
    if left:
        raise ValueError("the blocks before the range do not fill its slots")
    return placed


def pfair_range(parts: list[int], start: int, stop: int) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) of the slots from ``start`` to before ``stop``, by earliest deadline first under release times."""
    whole = sum(parts)
    done = placed_before(parts, start)
    waiting: dict[int, list[int]] = {}
    for s, p in enumerate(parts):
        waiting.setdefault(max(start, done[s] * whole // p), []).append(s)
    ready: list[tuple[int, int, int]] = []
    for slot in range(start, stop):
        for s in waiting.pop(slot, ()):
            heapq.heappush(ready, (-(-(done[s] + 1) * whole // parts[s]), -parts[s], s))
        if not ready:
            raise ValueError("the weights do not fill the slots")
        deadline, _, s = heapq.heappop(ready)
        if slot >= deadline:
            raise ValueError("a deadline was missed")
        yield s, done[s], slot
        done[s] += 1
        waiting.setdefault(max(slot + 1, done[s] * whole // parts[s]), []).append(s)


def pfair_period(parts: list[int]) -> list[list[int]]:
    """The slots of each source's blocks in the first sum(parts) slots, after which the schedule repeats."""
    slots: list[list[int]] = [[] for _ in parts]
    for s, _, slot in pfair_range(parts, 0, sum(parts)):
        slots[s].append(slot)
    return slots


def schedule_slots(spark: SparkSession, keys: list[str], parts: list[int], blocks: list[int], span: int) -> DataFrame:
    """(mix_key, mix_k, mix_at): the slot of each of the first ``blocks`` blocks of each source, in ranges of ``span`` slots or more."""
    whole = sum(parts)
    slots = max((-(-n * whole // p) for n, p in zip(blocks, parts, strict=True)), default=0)
    span = max(span, *[-(-whole // p) for p in parts]) if parts else span

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                made = [(keys[s], k, slot) for s, k, slot in pfair_range(parts, i * span, min(slots, (i + 1) * span)) if k < blocks[s]]
                if made:
                    names, numbers, at = zip(*made, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(at, pa.int64())], names=["mix_key", "mix_k", "mix_at"])

    ranges = -(-slots // span)
    return spark.range(0, ranges, 1, max(1, min(ranges // 4, 2000))).mapInArrow(run, "mix_key string, mix_k long, mix_at long")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK, period: int = PERIOD, cells: int | None = None) -> DataFrame:
    """``docs`` with mix_source_share, mix_block, mix_slot and mix_position; sort by mix_position to read the mixture.

    ``weights`` are targets by source; by default they go with the square root of a source's documents. The number of cells
    goes with the documents, so that a cell of one source never outgrows a task. Columns of ``docs`` that are called as the new ones are replaced,
    all others stay.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("mix_source_share", "mix_block", "mix_slot", "mix_position")]
    own = {c: f"u{i}" for i, c in enumerate(names)}  # so that no column of docs is called as one of those below
    base = docs.select(*[F.col(f"`{c}`").alias(u) for c, u in own.items()], F.xxhash64("doc_id", text_of()).alias("mix_hash"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("mix_key"))
    cells = cells or max(CELLS, docs.count() // CELL)
    base = base.withColumn("mix_cell", F.pmod("mix_hash", F.lit(cells)).cast("int"))
    sizes = base.groupBy("mix_key", "mix_cell").agg(F.count(F.lit(1)).alias("mix_n"))
    found = sorted((r[0], r[1]) for r in sizes.groupBy("mix_key").agg(F.sum("mix_n")).collect())
    parts = exact_shares([float((weights or {}).get(key[1:] if key else None, math.sqrt(n))) for key, n in found])
    keys = [key for key, _ in found]
    shared = spark.createDataFrame([(key, p / sum(parts)) for key, p in zip(keys, parts, strict=True)], "mix_key string, mix_share double")
    slots = schedule_slots(spark, keys, parts, [-(-n // block) for _, n in found], period)
    before = Window.partitionBy("mix_key").orderBy("mix_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("mix_key", "mix_cell", "mix_n", F.coalesce(F.sum("mix_n").over(before), F.lit(0)).alias("mix_before"))
    first, last = F.floor(F.col("mix_before") / F.lit(block)), F.floor((F.col("mix_before") + F.col("mix_n") - 1) / F.lit(block))
    cut = offsets.select("mix_key", "mix_cell", "mix_before", F.explode(F.sequence(first, last)).alias("mix_k")).join(slots, ["mix_key", "mix_k"])
    cut = cut.groupBy("mix_key", "mix_cell", "mix_before").agg(F.array_sort(F.collect_list(F.struct("mix_k", "mix_at"))).alias("mix_slots")).join(shared, "mix_key")
    ranked = base.withColumn("mix_rank", F.row_number().over(Window.partitionBy("mix_key", "mix_cell").orderBy("mix_hash", own["doc_id"])) - 1)
    joined = ranked.join(cut, ["mix_key", "mix_cell"])
    number = F.col("mix_before") + F.col("mix_rank")
    k = F.floor(number / F.lit(block))
    slot = F.col("mix_slots")[(k - F.floor(F.col("mix_before") / F.lit(block))).cast("int")]["mix_at"]
    return joined.select(
        *[F.col(u).alias(c) for c, u in own.items()],
        F.col("mix_share").alias("mix_source_share"),
        k.cast("long").alias("mix_block"),
        slot.cast("long").alias("mix_slot"),
        (slot * F.lit(block) + F.pmod(number, F.lit(block))).cast("long").alias("mix_position"),
    )
