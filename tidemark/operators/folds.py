"""The fold of accepted prices over series of any length, in parallel.

A price is accepted if it is sound and lies within ``max_jump`` of the last accepted price of its symbol (or there is none), so every
price depends on all before it. The fold is a function of the last accepted price, and functions compose: each
symbol's days are folded at once for every possible last price, what they do to it is carried from day to day over a small table, and
the days are then folded once more, each from the price that is now known.

What a day does to an unknown last price L is a short list. The first sound price that accepts L ends its being unknown; from there on the
fold is known, and such threads run together as soon as they accept a price in common. So the list has, in order of time, ranges of
prices that lead to the same end; L takes the first range that accepts it, and stays as it is if none does. A range stands for all
its prices: they lie so close (within half the jump) that what accepts L between two of them accepts one of them as well.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scans import span_of

MAX_JUMP = 0.20


def accepts(last: float | None, price: float, max_jump: float) -> bool:
    return last is None or abs(price - last) / last <= max_jump


def fold_from(last: float | None, prices: list, sound: list, max_jump: float) -> tuple[float | None, list[bool]]:
    """The last accepted price after all, and which were accepted."""
    flags = []
    for p, ok in zip(prices, sound, strict=True):
        ok = bool(ok) and accepts(last, p, max_jump)
        if ok:
            last = p
        flags.append(ok)
    return last, flags


def effect(prices: list, sound: list, max_jump: float) -> tuple[float | None, list[tuple[float, float, float]]]:
    """(end without a last price before, [(low, high, end)]): what the prices do to a last price they do not know."""
    close = 1 + max_jump / 2
    seen: list[float] = []  # sound prices that an unknown last price may have met first, sorted
    firsts: list[float] = []  # the same in order of time
    threads: dict[float, list[int]] = {}  # accepted price -> places in firsts that have come to it
    fresh: float | None = None  # the fold without a last price before
    for p, ok in zip(prices, sound, strict=True):
        if not ok:
            continue
        if accepts(fresh, p, max_jump):
            fresh = p
        moved: list[int] = []
        for last in [x for x in threads if accepts(x, p, max_jump)]:
            own = threads.pop(last)
            moved, own = (own, moved) if len(own) > len(moved) else (moved, own)
            moved.extend(own)
        at = bisect.bisect_left(seen, p)
        known = (at < len(seen) and seen[at] == p) or (0 < at < len(seen) and seen[at] <= seen[at - 1] * close)
        if not known:
            seen.insert(at, p)
            moved.append(len(firsts))
            firsts.append(p)
        if moved:
            threads[p] = moved
    ends: list[float] = [math.nan] * len(firsts)
    for last, own in threads.items():
        for i in own:
            ends[i] = last
    ranges: list[list[float]] = []
    for p, end in zip(firsts, ends, strict=True):
        if ranges and ranges[-1][2] == end and ranges[-1][0] <= p * close and p <= ranges[-1][1] * close:
            ranges[-1][0], ranges[-1][1] = min(ranges[-1][0], p), max(ranges[-1][1], p)
        else:
            ranges.append([p, p, end])
    return fresh, [tuple(r) for r in ranges]


def apply_effect(last: float | None, fresh: float | None, ranges: list, max_jump: float) -> float | None:
    if last is None:
        return fresh
    for low, high, end in ranges:
        if low <= last <= high or accepts(last, low, max_jump) or accepts(last, high, max_jump):
            return end
    return last


def fold_prices(prices: DataFrame, sound: Column, max_jump: float = MAX_JUMP, key: str = "symbol", ts: str = "ts", price: str = "mark_price", ms: int = 86_400_000) -> DataFrame:
    """(key, ts, price, accepted) of every row. Rows of a key and time are taken in order of price; a null price is never sound.

    Day and symbol go to one task; the days of a symbol meet as a table of a few numbers a day.
    """
    kinds = dict(prices.dtypes)
    ok = F.coalesce(sound, F.lit(False)).alias("_ok")
    rows = prices.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.col(price).cast("double").alias("_p"), ok, F.coalesce(span_of(ts, kinds[ts], ms), F.lit(-(1 << 60))).alias("_day"))

    def of_day(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", "_p"], kind="stable")
        fresh, ranges = effect(pdf["_p"].tolist(), pdf["_ok"].tolist(), max_jump)
        columns = [list(c) for c in zip(*ranges, strict=True)] or [[], [], []]
        return pd.DataFrame({"_k": [pdf["_k"].iloc[0]], "_day": [pdf["_day"].iloc[0]], "fresh": [fresh], "low": [columns[0]], "high": [columns[1]], "ending": [columns[2]]})

    summary = f"_k {kinds[key]}, _day long, fresh double, low array<double>, high array<double>, ending array<double>"
    days = rows.groupBy("_k", "_day").applyInPandas(of_day, summary)

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_day")
        last, out = None, []
        for fresh, low, high, ending in zip(pdf["fresh"], pdf["low"], pdf["high"], pdf["ending"], strict=True):
            out.append(last)
            last = apply_effect(last, None if fresh != fresh else fresh, list(zip(low, high, ending, strict=True)), max_jump)
        return pd.DataFrame({"_k": pdf["_k"], "_day": pdf["_day"], "_last": pd.Series(out, index=pdf.index, dtype="float64")})

    before = days.groupBy("_k").applyInPandas(starts, f"_k {kinds[key]}, _day long, _last double")

    def again(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["_t", "_p"], kind="stable")
        last = right["_last"].iloc[0] if len(right) else None
        _, flags = fold_from(None if last is None or last != last else float(last), left["_p"].tolist(), left["_ok"].tolist(), max_jump)
        return pd.DataFrame({"_k": left["_k"], "_t": left["_t"], "_p": left["_p"], "accepted": flags})

    folded = rows.groupBy("_k", "_day").cogroup(before.groupBy("_k", "_day")).applyInPandas(again, f"_k {kinds[key]}, _t {kinds[ts]}, _p double, accepted boolean")
    return folded.select(F.col("_k").alias(key), F.col("_t").alias(ts), F.col("_p").alias(price), "accepted")
