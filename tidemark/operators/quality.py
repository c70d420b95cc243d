"""Validation rules, data-quality report and audit statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.detect import liq_sum_window
from tidemark.operators.folds import fold_prices
from tidemark.operators.scans import chunk_order, in_chunks, ntile_bands, percentiles
from tidemark.operators.windows import asof_backward, asof_forward, distribution, floor_index, gap_islands, log_return, missing_minutes, moments, nearest_rank, ordered, positive_ratio_log


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def guard_finite(df: DataFrame, *names: str, non_negative: bool = False) -> DataFrame:
    ok = F.lit(True)
    for n in names:
        ok = ok & finite(F.col(n)) & (F.col(n) >= 0 if non_negative else F.lit(True))
    return df.filter(ok)


def guard_mark_index(df: DataFrame, bound: float = 0.10) -> DataFrame:
    both = (F.col("mark_price") > 0) & (F.col("index_price") > 0)
    return df.filter(~both | (F.abs(F.col("mark_price") - F.col("index_price")) / F.col("index_price") <= bound))


def quote_rule(as_of: Column, max_deviation: float = 0.05, max_funding: float = 0.05, max_stale_ms: int = 15_000) -> Column:
    """First failing rule of a quote, null where it is sound."""
    bad = ~(finite(F.col("mark_price")) & finite(F.col("index_price")) & finite(F.col("funding_rate")) & finite(F.col("open_interest_usd")))
    both = (F.col("mark_price") > 0) & (F.col("index_price") > 0)
    apart = both & (F.abs(F.col("mark_price") - F.col("index_price")) / F.col("index_price") > max_deviation)
    age = F.unix_millis(as_of) - F.unix_millis("quote_ts")
    return F.when(bad, "NOT_FINITE").when(F.abs("funding_rate") > max_funding, "FUNDING_OUT_OF_RANGE").when(apart, "MARK_INDEX_DEVIATION").when(F.col("quote_ts").isNull(), "INVALID_TIMESTAMP").when(age > max_stale_ms, "STALE_DATA")


def validate_quotes(quotes: DataFrame, as_of: Column, **bounds) -> DataFrame:
    return quotes.withColumn("rule", quote_rule(as_of, **bounds))


def anomaly_events(validated: DataFrame) -> DataFrame:
    """exchange, symbol, rule, detail of the rejected rows."""
    detail = F.when(F.col("rule") == "MARK_INDEX_DEVIATION", F.format_string("mark=%.4f index=%.4f", "mark_price", "index_price")).otherwise(F.concat_ws(" ", "rule", "exchange"))
    return validated.filter("rule is not null").withColumn("detail", detail)


def drop_empty_venues(quotes: DataFrame, clean: DataFrame, *keys: str) -> DataFrame:
    """Quotes of the venues that have any clean quote, or any in the same ``keys`` (such as the batch)."""
    on = [*keys, "exchange"]
    return quotes.join(clean.select(*on).distinct(), on, "left_semi")


def liquidation_rule(as_of: Column) -> Column:
    bad = lambda c: ~finite(F.col(c)) | (F.col(c) <= 0)
    late = F.unix_millis("ts") > F.unix_millis(as_of) + 300_000
    return F.when(bad("price"), "PRICE").when(bad("quantity"), "QUANTITY").when(bad("usd_value"), "USD_VALUE").when(~F.col("side").isin("BUY", "SELL"), "SIDE").when(late, "FUTURE")


def funding_rule(as_of: Column, bound: float = 0.05) -> Column:
    late = F.unix_millis("funding_time") > F.unix_millis(as_of) + 300_000
    return F.when(~finite(F.col("funding_rate")), "NOT_FINITE").when(F.abs("funding_rate") > bound, "OUT_OF_RANGE").when(late, "FUTURE")


def open_interest_rule(as_of: Column) -> Column:
    late = F.unix_millis("ts") > F.unix_millis(as_of) + 300_000
    return F.when(~finite(F.col("open_interest_usd")), "NOT_FINITE").when(F.col("open_interest_usd") < 0, "NEGATIVE").when(late, "FUTURE")


def mark_price_sound(as_of: Column | None = None) -> Column:
    """Finite, above zero and, with ``as_of``, no more than five minutes after it."""
    sound = finite(F.col("mark_price")) & (F.col("mark_price") > 0)
    return sound if as_of is None else sound & (F.unix_millis("ts") <= F.unix_millis(as_of) + 300_000)


def validate_mark_prices(prices: DataFrame, as_of: Column | None = None, max_jump: float = 0.20) -> DataFrame:
    """(symbol, ts, mark_price, accepted): a price is compared with the last accepted one of its symbol, so this is a fold, not a lag.

    The fold runs by symbol and day in parallel (``folds.fold_prices``).
    """
    return fold_prices(prices, mark_price_sound(as_of), max_jump)


def table_stats(df: DataFrame, ts: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.unix_millis(F.min(ts)).alias("first_ms"), F.unix_millis(F.max(ts)).alias("last_ms"))


def pk_duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def coverage(present: DataFrame) -> DataFrame:
    """Per symbol: expected and present minutes and the share in percent."""
    m = present.select("symbol", F.date_trunc("minute", "ts").alias("m")).distinct()
    out = m.groupBy("symbol").agg(F.count(F.lit(1)).alias("present"), ((F.unix_seconds(F.max("m")) - F.unix_seconds(F.min("m"))) / 60 + 1).cast("long").alias("expected"))
    return out.withColumn("coverage_pct", F.col("present") / F.col("expected") * 100.0)


def outliers_8sigma(df: DataFrame, value: str = "mark_price", k: float = 8.0) -> DataFrame:
    w = Window.partitionBy("symbol")
    flagged = df.withColumn("_o", F.abs(F.col(value) - F.avg(value).over(w)) > k * F.stddev_samp(value).over(w))
    return flagged.groupBy("symbol").agg(F.count_if("_o").alias("outliers"))


def jumps(df: DataFrame, bound: float = 0.10) -> DataFrame:
    """Per symbol: number of price changes above the bound, the largest change and its time."""
    change = F.abs(F.col("mark_price") / F.lag("mark_price").over(ordered()) - 1.0)
    c = df.withColumn("_c", change)
    return c.groupBy("symbol").agg(F.count_if(F.col("_c") > bound).alias("jumps"), F.max("_c").alias("worst"), F.unix_millis(F.max_by("ts", F.struct("_c", -F.unix_millis("ts")))).alias("worst_ms"))


def oi_change_stats(oi: DataFrame, spike: float = 15.0) -> DataFrame:
    before = F.lag("open_interest_usd").over(ordered())
    c = oi.withColumn("_c", F.when(before > 0, (F.col("open_interest_usd") - before) / F.when(before > 0, before) * 100.0))
    return c.groupBy("symbol").agg(F.avg("_c").alias("mean"), F.stddev_samp("_c").alias("std"), F.count_if(F.abs("_c") > spike).alias("spikes"), F.max(F.abs("_c")).alias("worst"))


def oi_price_corr(oi: DataFrame, prices: DataFrame) -> DataFrame:
    hourly = lambda df, c: df.groupBy("symbol", F.date_trunc("hour", "ts").alias("hr")).agg(F.avg(c).alias(c))
    return hourly(oi, "open_interest_usd").join(hourly(prices, "mark_price"), ["symbol", "hr"]).groupBy("symbol").agg(F.corr("open_interest_usd", "mark_price").alias("corr"), F.count(F.lit(1)).alias("hours"))


def liq_bursts_hourly(liqs: DataFrame, prices: DataFrame, p: float = 0.95, top: int = 20) -> DataFrame:
    """The ``top`` hours per symbol whose liquidated USD reach the p-th sorted value, with the 30-minute price move."""
    hourly = liqs.groupBy("symbol", F.date_trunc("hour", "ts").alias("hr")).agg(
        F.sum("usd_value").alias("usd"), F.sum(F.when(F.col("side") == "BUY", F.col("usd_value")).otherwise(0.0)).alias("buy"), F.sum(F.when(F.col("side") == "SELL", F.col("usd_value")).otherwise(0.0)).alias("sell")
    )
    limit = hourly.groupBy("symbol").agg(floor_index(F.sort_array(F.collect_list("usd")), p).alias("limit"))
    n = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("usd"), "hr"))
    bursts = hourly.join(limit, "symbol").filter("usd >= limit").withColumn("place", n).filter(F.col("place") <= top)
    bursts = bursts.withColumn("side", F.when(F.col("buy") > F.col("sell"), "BUY").otherwise("SELL")).withColumn("until", F.col("hr") + F.expr("interval 30 minutes"))
    start = asof_forward(bursts, prices, "mark_price", left_ts="hr", name="from_price")
    both = asof_backward(start, prices, "mark_price", left_ts="until", name="to_price")
    move = (F.col("to_price") - F.col("from_price")) / F.col("from_price") * 100.0
    consistent = ((F.col("side") == "SELL") & (move < 0)) | ((F.col("side") == "BUY") & (move > 0))
    return both.select("symbol", F.unix_millis("hr").alias("hr_ms"), "usd", "side", F.col("place").cast("long").alias("place"), move.alias("move_pct"), F.coalesce(consistent, F.lit(False)).alias("consistent"))


def liq_return_corr(liqs: DataFrame, prices: DataFrame, low: float = 0.05) -> DataFrame:
    """Correlation of 5-minute liquidations with the absolute log return of bins that have at least two prices, and whether it is too low."""
    bin_ = lambda ts: F.floor(F.unix_seconds(ts) / 300)
    l5 = liqs.groupBy("symbol", bin_("ts").alias("bin")).agg(F.sum("usd_value").alias("usd"))
    p5 = prices.groupBy("symbol", bin_("ts").alias("bin")).agg(F.min_by("mark_price", "ts").alias("a"), F.max_by("mark_price", "ts").alias("b"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    j = l5.join(p5, ["symbol", "bin"]).withColumn("r", F.abs(F.ln(F.col("b") / F.col("a"))))
    c = F.corr("usd", "r")
    out = j.groupBy("symbol").agg(F.when(~F.isnan(c), c).alias("corr"), F.count(F.lit(1)).alias("bins"))
    return out.withColumn("suspicious", F.coalesce("corr", F.lit(0.0)) < low)


def realized_vol(prices: DataFrame, rows: int = 30, scale: float = 1.0) -> DataFrame:
    """rv: sample deviation of the last ``rows`` log returns, with their number cnt."""
    w = chunk_order()
    frame = w.rowsBetween(-(rows - 1), 0)
    r = in_chunks(prices, rows).withColumn("ret", positive_ratio_log(F.col("mark_price"), F.lag("mark_price").over(w)))
    out = r.withColumn("rv", F.stddev_samp("ret").over(frame) * scale).withColumn("cnt", F.count("ret").over(frame))
    return out.filter("_mine").select(*prices.columns, "ret", "rv", "cnt")


def gaps_cv(df: DataFrame, ts: str = "ts", positive: bool = True, even: float = 0.3) -> DataFrame:
    """Coefficient of variation of the seconds between rows (of those above 0), and whether they are suspiciously even."""
    d = (F.unix_millis(ts) - F.unix_millis(F.lag(ts).over(ordered(ts=ts)))) / 1000.0
    g = df.withColumn("_d", d).filter("_d > 0" if positive else "_d is not null")
    cv = F.stddev_samp("_d") / F.avg("_d")
    return g.groupBy("symbol").agg(cv.alias("cv"), F.count(F.lit(1)).alias("gaps"), (cv < even).alias("even"))


def return_moments(prices: DataFrame) -> DataFrame:
    """Moments, extremes and percentiles of the log returns, and whether their kurtosis is above 3."""
    r = log_return(prices).filter("ret is not null")
    ends = percentiles(r, "ret", (0.5, 0.9, 0.95, 0.99, 0.999), "symbol", extra=(F.min("ret").alias("min"), F.max("ret").alias("max"))).drop("n").withColumnRenamed("q", "_q")
    m = moments(r, "ret", "symbol").join(ends, "symbol")
    return m.select("symbol", "n", "mean", "std", "skew", "kurtosis", "min", "max", *[F.col("_q")[i].alias(n) for i, n in enumerate(("p50", "p90", "p95", "p99", "p999"))], F.coalesce(F.col("kurtosis") > 3, F.lit(False)).alias("fat_tailed"))


def weekend_vol_ratio(prices: DataFrame) -> DataFrame:
    hourly = prices.groupBy("symbol", F.date_trunc("hour", "ts").alias("hr")).agg((F.stddev_samp("mark_price") / F.nullif(F.avg("mark_price"), F.lit(0.0))).alias("v"))
    weekend = F.dayofweek("hr").isin(1, 7)
    out = hourly.groupBy("symbol").agg(F.avg(F.when(weekend, F.col("v"))).alias("weekend"), F.avg(F.when(~weekend, F.col("v"))).alias("weekday"))
    return out.withColumn("ratio", F.when(F.col("weekday") > 0, F.col("weekend") / F.col("weekday")).otherwise(1.0))


def arch_autocorr(prices: DataFrame, least: float = 0.05) -> DataFrame:
    """Correlation of squared log returns with the ones before, and whether volatility clusters."""
    r = log_return(prices).withColumn("r2", F.col("ret") * F.col("ret"))
    r = r.filter("r2 is not null").withColumn("before", F.lag("r2").over(ordered()))
    return r.groupBy("symbol").agg(F.corr("r2", "before").alias("autocorr"), (F.corr("r2", "before") > least).alias("clustered"))


def liq_by_vol_tercile(liqs: DataFrame, prices: DataFrame, rows: int = 30) -> DataFrame:
    """Liquidations by third of realised volatility, and whether the top third has over twice the lowest's."""
    rv = realized_vol(prices, rows).filter("rv is not null")
    t = ntile_bands(rv, "rv", 3, name="tercile")
    per = liqs.groupBy("symbol", F.date_trunc("minute", "ts").alias("ts")).agg(F.sum("usd_value").alias("usd"), F.count(F.lit(1)).alias("n"))
    out = t.join(per, ["symbol", "ts"], "left").groupBy("symbol", "tercile").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("liquidations"), F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"))
    third = lambda k: F.max(F.when(F.col("tercile") == k, F.col("liquidations"))).over(Window.partitionBy("symbol"))
    return out.withColumn("clustered", third(3) > 2 * third(1))


def audit_cascades(prices: DataFrame, liqs: DataFrame, rows: int = 30, bound_pct: float = 2.0, top: int = 100, p: float = 0.95, minutes: int = 30) -> DataFrame:
    """Cascade candidates (symbol, ts, move_pct, direction, usd): the largest of each hour.

    A candidate moves at least ``bound_pct`` over ``rows`` rows, and the liquidations of its ``minutes`` reach the p-th
    percentile of the symbol's hours (unless that is 0). Of the ``top`` largest moves of a symbol the first of each hour stays.
    """
    end = F.lead("mark_price", rows).over(ordered())
    move = F.round(F.abs(F.col("_end") - F.col("mark_price")) / F.when(F.col("mark_price") != 0, F.col("mark_price")) * 100.0, 9)
    c = prices.withColumn("_end", end).filter("_end is not null").withColumn("move_pct", move).filter(F.col("move_pct") >= bound_pct)
    c = c.select("symbol", "ts", "move_pct", F.when(F.col("_end") < F.col("mark_price"), "DOWN").otherwise("UP").alias("direction"), F.unix_millis("ts").alias("start_ms")).withColumn("end_ms", F.col("start_ms") + minutes * 60_000)
    hourly = liqs.groupBy("symbol", F.date_trunc("hour", "ts").alias("hr")).agg(F.sum("usd_value").alias("usd"))
    limit = percentiles(hourly, "usd", (p,), "symbol").select("symbol", F.col("q")[0].alias("_limit"))
    heavy = liq_sum_window(c, liqs).join(limit, "symbol", "left").withColumn("_limit", F.coalesce("_limit", F.lit(0.0)))
    heavy = heavy.filter((F.round("usd", 6) >= F.round("_limit", 6)) | (F.col("_limit") == 0))
    by_move = [F.desc("move_pct"), F.col("ts")]
    best = heavy.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(*by_move))).filter(F.col("_n") <= top)
    hour = F.row_number().over(Window.partitionBy("symbol", F.date_trunc("hour", "ts")).orderBy(*by_move))
    return best.withColumn("_h", hour).filter("_h = 1").select("symbol", "ts", "move_pct", "direction", "usd")


def monthly_cv(cascades: DataFrame, ts: str = "ts", uneven: float = 0.3) -> DataFrame:
    """Coefficient of variation (population) of a symbol's cascades per month, and whether it is above ``uneven``."""
    per = cascades.groupBy("symbol", F.date_trunc("month", ts).alias("_m")).agg(F.count(F.lit(1)).alias("n"))
    cv = F.stddev_pop("n") / F.avg("n")
    return per.groupBy("symbol").agg(F.count(F.lit(1)).alias("months"), cv.alias("cv"), (cv > uneven).alias("uneven"))


def synthetic_heuristics(prices: DataFrame, liqs: DataFrame, funding: DataFrame, oi: DataFrame) -> DataFrame:
    """(symbol, test, value, pass) of the eight tests that real market data passes; a statistic without data counts as 0.

    Fixed values: the bounds of the tests.
    """
    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    symbols = prices.select("symbol").distinct()
    parts = [
        gaps_cv(prices, positive=False).select("symbol", F.col("cv").alias("spacing")),
        missing_minutes(prices).groupBy("symbol").agg(F.count(F.lit(1)).alias("missing")),
        moments(log_return(prices).filter("ret is not null"), "ret", "symbol").select("symbol", "kurtosis", F.col("std").alias("ret_std")),
        liqs.groupBy("symbol").agg((F.stddev_samp("usd_value") / F.avg("usd_value")).alias("size_cv"), F.count(F.lit(1)).alias("n_liqs")),
        weekend_vol_ratio(prices).select("symbol", F.coalesce(F.col("weekend") / F.when(F.col("weekday") > 0, F.col("weekday")), F.when(F.col("weekday") > 0, 0.0).otherwise(1.0)).alias("weekend_ratio")),
        moments(funding, "funding_rate", "symbol").select("symbol", F.col("skew").alias("funding_skew")),
        oi_change_stats(oi).select("symbol", F.col("std").alias("oi_std")),
        arch_autocorr(prices).select("symbol", "autocorr"),
    ]
    x = symbols
    for part in parts:
        x = x.join(part, "symbol", "left")
    tests = [
        ("uniform_timestamp_spacing", zero("spacing"), (zero("spacing") > 0.01) | (F.coalesce("missing", F.lit(0)) > 0)),
        ("heavy_tails", zero("kurtosis"), zero("kurtosis") > 3),
        ("distribution_realism", zero("ret_std"), zero("ret_std") > 1e-6),
        ("liquidation_size_variety", zero("size_cv"), (zero("size_cv") > 0.5) | (F.coalesce("n_liqs", F.lit(0)) == 0)),
        ("weekend_liquidity_difference", zero("weekend_ratio"), (F.abs(zero("weekend_ratio") - 1) > 0.01) | (zero("weekend_ratio") < 1)),
        ("funding_asymmetry", zero("funding_skew"), F.abs(zero("funding_skew")) > 0.1),
        ("oi_curve_roughness", zero("oi_std"), zero("oi_std") > 1e-6),
        ("volatility_clustering", zero("autocorr"), zero("autocorr") > 0.05),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("test"), v.alias("value"), ok.alias("pass")) for n, v, ok in tests])
    return x.select("symbol", F.explode(rows).alias("x")).select("symbol", "x.*")


def data_quality_report(prices: DataFrame, liqs: DataFrame, funding: DataFrame, oi: DataFrame) -> DataFrame:
    """Per symbol: rows and time span of the four tables, gaps of the prices, and four distributions."""
    named = (("marks", prices, "ts"), ("liqs", liqs, "ts"), ("funding", funding, "funding_time"), ("oi", oi, "ts"))
    out = prices.select("symbol").distinct()
    for name, df, ts in named:
        stats = table_stats(df, ts, "symbol")
        out = out.join(stats.select("symbol", *[F.col(c).alias(f"{name}_{c}") for c in ("n", "first_ms", "last_ms")]), "symbol", "left")
    gaps = gap_islands(missing_minutes(prices)).groupBy("symbol").agg(F.sum("minutes").alias("missing_minutes"), F.count(F.lit(1)).alias("gaps"), F.max("minutes").alias("longest_gap"))
    out = out.join(gaps, "symbol", "left").fillna(0, ["missing_minutes", "gaps", "longest_gap"])
    values = (("returns", log_return(prices).filter("ret is not null"), "ret"), ("liq_usd", liqs, "usd_value"), ("rate", funding, "funding_rate"), ("oi_usd", oi, "open_interest_usd"))
    for name, df, value in values:
        d = distribution(df, value, "symbol")
        out = out.join(d.select("symbol", *[F.col(c).alias(f"{name}_{c}") for c in ("n", "mean", "std", "min", "p25", "p50", "p75", "max")]), "symbol", "left")
    return out


def quality_score(audit: DataFrame) -> DataFrame:
    """score, rating and deductions from mark_rows, liq_rows, funding_rows, oi_rows, coverage_pct, duplicates, nonpositive, negative_oi, kurtosis, jumps, heuristic_fails."""
    c = F.col
    some = c("mark_rows") > 0
    rules = [
        (c("mark_rows") == 0, 40, "no mark prices"),
        (c("liq_rows") == 0, 15, "no liquidations"),
        (c("funding_rows") == 0, 10, "no funding rates"),
        (c("oi_rows") == 0, 10, "no open interest"),
        (some & (c("coverage_pct") < 95), 10, "coverage under 95"),
        (some & (c("coverage_pct") < 80), 10, "coverage under 80"),
        (c("duplicates") > 0, 10, "duplicate keys"),
        (c("nonpositive") > 0, 10, "prices not positive"),
        (c("negative_oi") > 0, 5, "negative open interest"),
        (some & ~F.coalesce(c("kurtosis") > 3, F.lit(False)), 10, "returns not fat-tailed"),
        (c("jumps") > 5, 5, "many jumps"),
        (c("heuristic_fails") >= 4, 25, "four heuristics failed"),
        ((c("heuristic_fails") >= 2) & (c("heuristic_fails") < 4), 10, "two heuristics failed"),
    ]
    taken = F.lit(100)
    for on, points, _ in rules:
        taken = taken - F.when(on, points).otherwise(0)
    score = F.greatest(F.lit(0), taken).cast("long")
    why = F.filter(F.array(*[F.when(on, F.lit(text)) for on, _, text in rules]), lambda x: x.isNotNull())
    rating = F.when(score >= 85, "EXCELLENT").when(score >= 70, "STRONG").when(score >= 50, "MODERATE").when(score >= 25, "WEAK").otherwise("INVALID")
    return audit.select(*audit.columns, score.alias("score"), rating.alias("rating"), F.concat_ws("; ", why).alias("deductions"))


def venue_latency_stats(calls: DataFrame, samples: int = 100) -> DataFrame:
    """Nearest-rank latencies of each venue's last samples, with averages and the error rate."""
    n = F.row_number().over(Window.partitionBy("exchange").orderBy(F.desc("ts"), F.desc("event_id")))
    last = calls.withColumn("_n", n).filter(F.col("_n") <= samples)
    out = last.groupBy("exchange").agg(F.sort_array(F.collect_list("latency_ms")).alias("v"), F.avg("latency_ms").alias("avg"), F.min("latency_ms").alias("min"), F.max("latency_ms").alias("max"), F.avg(F.col("is_error").cast("double")).alias("error_rate"))
    return out.select("exchange", *[nearest_rank(F.col("v"), F.size("v"), p).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)], "avg", "min", "max", "error_rate")


def venue_health(status: DataFrame) -> DataFrame:
    """Per venue: down from 5 failures on, degraded from 2 or when rate-limited; and the overall state."""
    state = F.when(F.col("fails") >= 5, "down").when((F.col("fails") >= 2) | F.col("limited"), "degraded").otherwise("healthy")
    per = status.withColumn("state", state)
    every = per.agg(F.avg((F.col("state") == "down").cast("double")).alias("_d"), F.max((F.col("state") != "healthy").cast("int")).alias("_a"))
    return per.crossJoin(F.broadcast(every)).withColumn("overall", F.when(F.col("_d") > 0.5, "unhealthy").when(F.col("_a") == 1, "degraded").otherwise("healthy")).drop("_d", "_a")
