"""Time-series building blocks over (key, ts): returns, sliding statistics, as-of joins, islands and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import in_chunks, percentiles, sliding_stats, span_of

KEY, TS = "symbol", "ts"


def ordered(key: str = KEY, ts: str = TS):
    return Window.partitionBy(key).orderBy(ts)


def positive_ratio_log(a: Column, b: Column) -> Column:
    """ln(a / b) where both are positive, else null."""
    return F.when((a > 0) & (b > 0), F.ln(F.when(b > 0, a / b)))


def log_return(df: DataFrame, price: str = "mark_price", key: str = KEY, ts: str = TS, name: str = "ret") -> DataFrame:
    return df.withColumn(name, positive_ratio_log(F.col(price), F.lag(price).over(ordered(key, ts))))


def forward_return(df: DataFrame, rows: int = 30, price: str = "mark_price", key: str = KEY, ts: str = TS, name: str = "fwd") -> DataFrame:
    return df.withColumn(name, positive_ratio_log(F.lead(price, rows).over(ordered(key, ts)), F.col(price)))


def prefix_stats(df: DataFrame, value: str, rows: int, include_current: bool = True, key: str = KEY, ts: str = TS, prefix: str = "w", chunk: int | None = None, position: str | None = None) -> DataFrame:
    """Count, mean, population and sample deviation of the last ``rows`` values: ``scans.sliding_stats``."""
    return sliding_stats(df, value, rows, include_current, key, ts, prefix, chunk, position)


#: Days that a bucket of the pass over days holds, and how far the last value of a series reaches.
DAYS, REACH = 64, 36_500


def _asof(left: DataFrame, right: DataFrame, value: str, left_ts: str, right_ts: str, key: str, before: str | None, after: str | None, tie: str | None = None) -> DataFrame:
    """``left`` with the value ``before`` and the value ``after`` each row, in one stream per key and day.

    Of right rows at equal times the one with the largest ``tie`` counts before a row, that with the smallest after it; without ``tie`` any.

    What a day lacks comes from the nearest day of the right side that has it: that day's value holds for all days up to the
    next one, at most REACH. Such spans of days are few, and meet rows by bucket.
    """
    names = left.columns
    values = right.select(F.col(key), F.col(right_ts).alias("_t"), *([F.col(tie).alias("_tie")] if tie else []), F.struct(F.col(value).alias("v")).alias("_v"))
    both = left.withColumn("_t", F.col(left_ts)).withColumn("_left", F.lit(True)).unionByName(values, allowMissingColumns=True)
    day = span_of("_t", dict(both.dtypes)["_t"])
    found = both.withColumn("_day", day).repartition(key, "_day")  # sides that lie together by key would stay so, a series a task
    for name, toward in ((before, F.asc), (after, F.desc)):
        if name:  # at equal times a right row comes first in either direction
            own = Window.partitionBy(key, "_day").orderBy(toward("_t"), F.col("_left").asc_nulls_first(), *([toward("_tie")] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
            found = found.withColumn(f"_o_{name}", F.last("_v", ignorenulls=True).over(own))
    found = found.filter("_left").withColumn("_bucket", F.floor(F.col("_day") / DAYS))
    out, kept = found, {n: found[n] for n in names}
    for name, nearest, toward, back in ((before, F.max_by, F.asc, True), (after, F.min_by, F.desc, False)):
        if not name:
            continue
        days = values.withColumn("_day", day).groupBy(F.col(key).alias("_k"), "_day").agg(nearest("_v", F.struct("_t", "_tie") if tie else "_t").alias("_c"))
        following = F.lead("_day").over(Window.partitionBy("_k").orderBy(toward("_day")))
        lo, hi = (F.col("_day") + 1, F.coalesce(following, F.col("_day") + REACH)) if back else (F.coalesce(following, F.col("_day") - REACH), F.col("_day") - 1)
        spans = days.select("_k", "_c", lo.alias("_lo"), hi.alias("_hi")).select("*", F.explode(F.sequence(F.floor(F.col("_lo") / DAYS), F.floor(F.col("_hi") / DAYS))).alias("_kb"))
        on = (found[key] == spans["_k"]) & (found["_bucket"] == spans["_kb"]) & found["_day"].between(spans["_lo"], spans["_hi"])
        out = out.join(spans, on, "left")
        kept[name] = F.coalesce(found[f"_o_{name}"], spans["_c"])["v"].alias(name)
    return out.select(*kept.values())


def asof_backward(left: DataFrame, right: DataFrame, value: str, left_ts: str = TS, right_ts: str = TS, key: str = KEY, name: str | None = None) -> DataFrame:
    """``left`` with the latest ``right`` value at or before each row. A key's rows are spread over tasks by day."""
    return _asof(left, right, value, left_ts, right_ts, key, name or value, None)


def asof_forward(left: DataFrame, right: DataFrame, value: str, left_ts: str = TS, right_ts: str = TS, key: str = KEY, name: str | None = None) -> DataFrame:
    """``left`` with the earliest ``right`` value at or after each row; at equal times the right row counts as after."""
    return _asof(left, right, value, left_ts, right_ts, key, None, name or value)


def asof_around(left: DataFrame, right: DataFrame, value: str, before: str, after: str, left_ts: str = TS, right_ts: str = TS, key: str = KEY, tie: str | None = None) -> DataFrame:
    """Both of them, in one stream. Right rows at equal times go by ``tie``."""
    return _asof(left, right, value, left_ts, right_ts, key, before, after, tie)


def minute_grid(df: DataFrame, key: str = KEY, ts: str = TS) -> DataFrame:
    """(key, ts) for every minute from each key's first to its last."""
    span = df.groupBy(key).agg(F.min(F.date_trunc("minute", ts)).alias("lo"), F.max(F.date_trunc("minute", ts)).alias("hi"))
    return span.select(key, F.explode(F.sequence("lo", "hi", F.expr("interval 1 minute"))).alias(ts))


def missing_minutes(df: DataFrame, key: str = KEY, ts: str = TS) -> DataFrame:
    present = df.select(key, F.date_trunc("minute", ts).alias(ts)).distinct()
    return minute_grid(df, key, ts).join(present, [key, ts], "left_anti")


def gap_islands(missing: DataFrame, key: str = KEY, ts: str = TS) -> DataFrame:
    """Runs of consecutive missing minutes: gap_start, gap_end, minutes."""
    n = F.row_number().over(ordered(key, ts))
    keyed = missing.withColumn("_g", F.floor(F.unix_seconds(ts) / 60) - n)
    return keyed.groupBy(key, "_g").agg(F.min(ts).alias("gap_start"), F.max(ts).alias("gap_end"), F.count(F.lit(1)).alias("minutes")).drop("_g")


def flatline_runs(df: DataFrame, value: str, least: int = 3, key: str = KEY, ts: str = TS) -> DataFrame:
    """Runs of at least ``least`` zero differences: run_start, run_end, diffs."""
    w = ordered(key, ts)
    diffs = df.withColumn("_d", F.col(value) - F.lag(value).over(w))
    grouped = diffs.withColumn("_g", F.sum(F.when(F.col("_d") == 0, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = grouped.filter("_d = 0").groupBy(key, "_g").agg(F.min(ts).alias("run_start"), F.max(ts).alias("run_end"), F.count(F.lit(1)).alias("diffs"))
    return runs.filter(F.col("diffs") >= least).drop("_g")


def moments(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """n, mean, std, skew and kurtosis (not excess) with the sample deviation in the denominators."""
    base = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    d = F.col(value) - F.col("mean")
    joined = df.join(base, list(keys)) if keys else df.crossJoin(F.broadcast(base))
    out = joined.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("std").alias("std"), F.avg(d * d * d).alias("_m3"), F.avg(d * d * d * d).alias("_m4")
    )
    s = F.when(F.col("std") > 0, F.col("std"))
    return out.select(*keys, "n", "mean", "std", (F.col("_m3") / (s * s * s)).alias("skew"), (F.col("_m4") / (s * s * s * s)).alias("kurtosis"))


def distribution(df: DataFrame, value: str, *keys: str, exact: bool = True) -> DataFrame:
    """n, mean, std, min, p25, p50, p75, max. Exact quantiles take a second pass; ``exact`` false keeps to the sketch of one."""
    points = (0.25, 0.5, 0.75)
    stats = (F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    if exact:
        out = percentiles(df, value, points, *keys, extra=stats)
    else:
        out = df.groupBy(*keys).agg(F.count(value).alias("n"), *stats, F.percentile_approx(value, F.array(*map(F.lit, points)), 10_000).alias("q"))
    return out.select(*keys, "n", "mean", "std", "min", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))], "max")


def rolling_order_stats(df: DataFrame, value: str, rows: int, quantiles: tuple[float, ...], chunk: int | None = None, rank: bool = False, key: str = KEY, ts: str = TS, position: str | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation) and percentile rank of the last ``rows`` values.

    Each series is cut into chunks; a row also goes to the later chunks that need it as halo, so one long series is
    worked on by many tasks and no task holds more than a chunk and its halo.
    """
    chunk = max(chunk or rows, 1)
    spread = in_chunks(df, rows - 1, key=key, ts=ts, chunk=chunk, position=position)
    names = [f"{value}_q{round(q * 100)}" for q in quantiles] + ([f"{value}_rank"] if rank else [])
    schema = spread.drop("_chunk", "_mine").schema
    for x in names:
        schema = schema.add(x, "double")

    def kernel(pdf):
        pdf = pdf.sort_values("_n").reset_index(drop=True)
        rolling = pdf[value].rolling(rows, min_periods=1)
        for q in quantiles:
            pdf[f"{value}_q{round(q * 100)}"] = rolling.quantile(q)
        if rank:
            pdf[f"{value}_rank"] = rolling.rank(method="max", pct=True) * 100.0
        return pdf[pdf["_mine"]].drop(columns=["_chunk", "_mine"])

    return spread.groupBy(key, "_chunk").applyInPandas(kernel, schema).drop("_n")


def nearest_rank(values: Column, n: Column, p: float) -> Column:
    """Element ceil(n p) - 1 of a sorted array."""
    return F.get(values, F.ceil(n * p).cast("int") - 1)


def floor_index(values: Column, p: float) -> Column:
    """Element floor(n p) of a sorted array, no interpolation; floor_index(v, 0.5) is the upper median."""
    return F.get(values, F.floor(F.size(values) * p).cast("int"))
