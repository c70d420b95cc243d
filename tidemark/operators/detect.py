"""Cascade detection on a minute grid per symbol: interpolated moves against volatility, liquidations against a trailing threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import DAY_MS, percentiles, running_totals, with_previous
from tidemark.operators.windows import asof_around, asof_backward, positive_ratio_log, rolling_order_stats

MINUTE = 60_000


def _ms(df: DataFrame) -> DataFrame:
    return df.withColumn("ms", F.unix_millis("ts"))


def interpolate_prices(points: DataFrame, prices: DataFrame, at: str = "ms", name: str = "price") -> DataFrame:
    """``points(symbol, at)`` with the price interpolated linearly between the observations around it, clamped at the ends.

    Of observations in one millisecond the last counts before a point and the first after it (of equal times, by price).
    """
    p = _ms(prices).select("symbol", "ms", F.struct("ts", "mark_price").alias("tie"), F.struct("ms", F.col("mark_price").alias("p")).alias("obs"))
    j = asof_around(points, p, "obs", "_a", "_b", left_ts=at, right_ts="ms", tie="tie")
    a, b = F.col("_a"), F.col("_b")
    between = a["p"] + (b["p"] - a["p"]) * (F.col(at) - a["ms"]) / F.when(b["ms"] > a["ms"], b["ms"] - a["ms"])
    return j.withColumn(name, F.coalesce(F.when(a.isNull(), b["p"]).when(b.isNull() | (a["ms"] == b["ms"]), a["p"]).otherwise(between))).drop("_a", "_b")


def trailing_annual_vol(points: DataFrame, prices: DataFrame, at: str = "ms", minutes: int = 1440, least: int = 30) -> DataFrame:
    """sigma: sqrt(mean r^2) x sqrt(525960) of the log returns with time in [t - minutes, t]; 0 under ``least`` returns.

    Running sums of r^2 and their number, read as of t and before t - minutes; both lags and sums are spread over tasks by day.
    """
    r = _ms(with_previous(prices.select("symbol", "ts", "mark_price"), "mark_price", "_last")).withColumn("_r", positive_ratio_log(F.col("mark_price"), F.col("_last"))).filter("_r is not null")
    per = r.groupBy("symbol", "ms").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_r") * F.col("_r")).alias("q"))
    run = running_totals(per, {"n": "n", "q": "q"}).select("symbol", "ms", F.struct("n", "q").alias("run"))
    j = asof_backward(points, run, "run", left_ts=at, right_ts="ms", name="_until")
    j = j.withColumn("_from", F.col(at) - minutes * MINUTE - 1)
    j = asof_backward(j, run, "run", left_ts="_from", right_ts="ms", name="_before")
    part = lambda c: F.coalesce(F.col(f"_until.{c}"), F.lit(0)) - F.coalesce(F.col(f"_before.{c}"), F.lit(0))
    n, q = part("n"), F.greatest(part("q"), F.lit(0.0))
    return j.select(*points.columns, F.when(n >= least, F.sqrt(q / F.when(n > 0, n)) * (525_960.0**0.5)).otherwise(0.0).alias("sigma"))


def detect_cascades(prices: DataFrame, liqs: DataFrame, window: int = 5, k: float = 4.0, lookback: int = 1440, floor_usd: float = 100_000.0, dominance: float = 0.65, merge_gap: int = 0) -> DataFrame:
    """Events (symbol, direction, start_ms, end_ms, price_change_pct, liquidation_usd).

    Grid from each symbol's first price, a minute apart, while t + window is within the prices. A grid point is a
    candidate if its absolute move exceeds k sigma sqrt(window) (in years), its liquidations reach the 95th percentile of
    the non-overlapping windows of the lookback (at least ``floor_usd``) and one side dominates; overlapping candidates
    of one direction merge, and move and volume are taken over the merged span.
    SELL orders close longs, BUY orders shorts.
    """
    span = _ms(prices).groupBy("symbol").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"))
    last = F.floor((F.col("hi") - F.col("lo")) / MINUTE).cast("long")
    grid = span.select("symbol", "lo", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("m")).withColumn("ms", F.col("lo") + F.col("m") * MINUTE)
    ahead = F.lead("p0", window).over(Window.partitionBy("symbol").orderBy("m"))
    moves = interpolate_prices(grid, prices, "ms", "p0").withColumn("p1", ahead).filter("p1 is not null").withColumn("end_ms", F.col("ms") + window * MINUTE)
    moves = trailing_annual_vol(moves, prices, "ms", lookback)
    sums = window_liquidations(span, liqs, window, lookback)
    phase = sums.withColumn("_k", F.concat_ws("|", "symbol", F.pmod("m", F.lit(window)).cast("string")))
    phase = phase.withColumn("prev", F.lag("usd").over(Window.partitionBy("_k").orderBy("m"))).withColumn("_p", F.floor((F.col("m") + lookback) / window))  # the grid is dense, so a place is a number
    buckets = lookback // window
    ranked = rolling_order_stats(phase, "prev", buckets, (0.95,), chunk=max(buckets, 4096), key="_k", ts="m", position="_p")
    n = F.least(F.col("_p"), F.lit(buckets))
    limits = ranked.withColumn("n", n).withColumn("limit", F.greatest(F.lit(floor_usd), F.when(F.col("n") >= 10, F.col("prev_q95")).otherwise(0.0)))
    j = moves.join(limits.select("symbol", "m", "long_usd", "short_usd", "usd", "limit"), ["symbol", "m"])
    years = F.sqrt(F.lit(window / 525_960.0))
    top = F.greatest("long_usd", "short_usd")
    hit = j.filter((F.col("p0") > 0) & (F.col("sigma") > 0) & (F.abs((F.col("p1") - F.col("p0")) / F.col("p0")) >= k * F.col("sigma") * years) & (F.col("usd") >= F.col("limit")) & ((F.col("usd") == 0) | (top / F.col("usd") >= dominance)))
    c = hit.select("symbol", F.when(F.col("long_usd") > F.col("short_usd"), "LONG_SQUEEZE").otherwise("SHORT_SQUEEZE").alias("direction"), F.col("ms").alias("start_ms"), "end_ms")
    merged = merge_candidates(c, merge_gap)
    ends = merged.select("*", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("start_ms").alias("at_ms")), F.struct(F.lit(1).alias("which"), F.col("end_ms").alias("at_ms")))).alias("_e")).select(*merged.columns, "_e.*")
    priced = interpolate_prices(ends, prices, "at_ms", "p").groupBy(*merged.columns)
    spanned = priced.agg(F.max(F.when(F.col("which") == 0, F.col("p"))).alias("p0"), F.max(F.when(F.col("which") == 1, F.col("p"))).alias("p1"))
    volume = liq_sum_window(spanned, liqs)
    return volume.select("symbol", "direction", "start_ms", "end_ms", ((F.col("p1") - F.col("p0")) / F.col("p0") * 100.0).alias("price_change_pct"), F.col("usd").alias("liquidation_usd"))


def window_liquidations(span: DataFrame, liqs: DataFrame, window: int, lookback: int) -> DataFrame:
    """(symbol, m, long_usd, short_usd, usd): sums over minutes [m, m + window) on a dense minute grid from -lookback on."""
    dense = span.select("symbol", F.explode(F.sequence(F.lit(-lookback).cast("long"), F.floor((F.col("hi") - F.col("lo")) / MINUTE).cast("long"))).alias("m"))
    minute = F.floor((F.unix_millis("ts") - F.col("lo")) / MINUTE).cast("long")
    per = liqs.join(span, "symbol").groupBy("symbol", minute.alias("m")).agg(
        F.sum(F.when(F.col("side") == "SELL", F.col("usd_value")).otherwise(0.0)).alias("_l"), F.sum(F.when(F.col("side") == "BUY", F.col("usd_value")).otherwise(0.0)).alias("_s")
    )
    w = Window.partitionBy("symbol").orderBy("m").rowsBetween(0, window - 1)
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0.0))
    return dense.join(per, ["symbol", "m"], "left").select("symbol", "m", total("_l").alias("long_usd"), total("_s").alias("short_usd")).withColumn("usd", F.col("long_usd") + F.col("short_usd"))


def merge_candidates(candidates: DataFrame, gap_ms: int = 0) -> DataFrame:
    """Islands of candidates: a new one starts where the start lies past the previous end or the direction differs."""
    w = Window.partitionBy("symbol").orderBy("start_ms")
    fresh = F.lag("end_ms").over(w).isNull() | (F.col("start_ms") > F.lag("end_ms").over(w) + gap_ms) | (F.col("direction") != F.lag("direction").over(w))
    g = candidates.withColumn("_f", fresh.cast("long")).withColumn("_g", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("symbol", "_g").agg(F.first("direction").alias("direction"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("_g")


def liq_sum_window(spans: DataFrame, liqs: DataFrame, a: str = "start_ms", b: str = "end_ms") -> DataFrame:
    """``spans`` with usd, the liquidations in [a, b): a difference of running sums, read as of the two ends.

    Ends are milliseconds, or timestamps, which are compared to the microsecond.
    """
    exact = dict(spans.dtypes)[a] == "timestamp"
    at = F.unix_micros("ts") if exact else F.unix_millis("ts")
    run = running_totals(liqs.groupBy("symbol", at.alias("_at")).agg(F.sum("usd_value").alias("v")), {"total": "v"}, at="_at", width=DAY_MS * (1000 if exact else 1))
    after = F.timestamp_micros(F.col("_at") + 1) if exact else F.col("_at") + 1
    run = run.select("symbol", after.alias("_at"), "total")
    j = asof_backward(spans, run, "total", left_ts=a, right_ts="_at", name="_before")
    j = asof_backward(j, run, "total", left_ts=b, right_ts="_at", name="_until")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return j.withColumn("usd", zero("_until") - zero("_before")).drop("_before", "_until")


def burst_within(points: DataFrame, bursts: DataFrame, minutes: int = 10) -> DataFrame:
    """``points`` (symbol, ts) with a burst no further than ``minutes``: both sides go to bins of that width, neighbours included."""
    width = minutes * 60
    bin_ = F.floor(F.unix_seconds("ts") / width)
    near = bursts.select("symbol", F.unix_seconds("ts").alias("_b"), F.explode(F.array(bin_ - 1, bin_, bin_ + 1)).alias("_bin"))
    left = points.withColumn("_bin", bin_).withColumn("_s", F.unix_seconds("ts"))
    on = (left["symbol"] == near["symbol"]) & (left["_bin"] == near["_bin"]) & (F.abs(left["_s"] - near["_b"]) <= width)
    return left.join(near, on, "left_semi").drop("_bin", "_s")


def liq_bins_5m(liqs: DataFrame) -> DataFrame:
    return liqs.groupBy("symbol", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 300) * 300).alias("ts")).agg(F.sum("usd_value").alias("usd"), F.count(F.lit(1)).alias("n"))


def liq_bursts_5m(liqs: DataFrame, p: float = 0.95) -> DataFrame:
    """Bins at or above the p-th percentile of their symbol's 5-minute bins."""
    bins = liq_bins_5m(liqs)
    limit = percentiles(bins, "usd", (p,), "symbol").select("symbol", F.col("q")[0].alias("limit"))
    return bins.join(limit, "symbol").filter("usd >= limit")


def event_id(kind: Column, start: Column) -> Column:
    return F.concat_ws(":", "symbol", kind, F.unix_millis(start).cast("string"))
