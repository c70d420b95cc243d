"""Scans, exact order statistics and folds against plain Python on random series with ties, nulls and gaps."""

import datetime as dt
import math
import random
import re
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, quality, scans, windows

T0 = dt.datetime(2024, 1, 1)


def walk(spark, n, seed=1, days=4.0, empty=0.1, symbols="ab"):
    rng = random.Random(seed)
    rows = []
    for s in symbols:
        p = 50_000.0
        for i in range(n):
            p *= math.exp(rng.gauss(0, 0.01))
            rows.append((s, T0 + dt.timedelta(seconds=int(i * days * 86_400 / n)), None if rng.random() < empty else round(p, 1)))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, x double").repartition(5), rows


def own(rows, s):
    return [r for r in rows if r[0] == s]


def test_positions_count_days(spark):
    df, rows = walk(spark, 300)
    got = {(r.symbol, r.ts): r.p for r in scans.with_positions(df, name="p").collect()}
    assert got == {(s, t): i for s in "ab" for i, (_, t, _) in enumerate(own(rows, s))}
    late = spark.createDataFrame([("a", None, 1.0), ("a", T0, 2.0), ("a", None, 3.0)], df.schema)
    assert sorted(r.p for r in scans.with_positions(late, name="p").collect()) == [0, 1, 2]
    assert next(r.p for r in scans.with_positions(late, name="p").collect() if r.ts) == 2


@pytest.mark.parametrize("rows_back", [1, 2, 7, 40, 1000])
@pytest.mark.parametrize("current", [True, False])
def test_sliding_stats(spark, rows_back, current):
    df, rows = walk(spark, 400)
    got = {(r.symbol, r.ts): r for r in scans.sliding_stats(df, "x", rows_back, current, chunk=64).collect()}
    assert len(got) == len(rows)
    for s in "ab":
        mine = own(rows, s)
        for i, (_, t, _) in enumerate(mine):
            w = [x for _, _, x in (mine[max(0, i - rows_back + 1) : i + 1] if current else mine[max(0, i - rows_back) : i]) if x is not None]
            r = got[s, t]
            assert r.w_n == len(w)
            assert (r.w_mean is None) == (not w) and (r.w_std is None) == (len(w) < 2)
            if w:
                assert r.w_mean == pytest.approx(statistics.fmean(w), rel=1e-12)
                assert r.w_std_pop == pytest.approx(statistics.pstdev(w), rel=1e-9, abs=1e-9)


def test_sliding_stats_keep_digits(spark):
    """A quiet stretch after a large move: the deviation of the last rows has all its digits, a constant stretch none."""
    x = [1e9 + i * 1e6 for i in range(3000)] + [1.0 + 1e-7 * (i % 3) for i in range(200)] + [0.1] * 100
    df = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=i), v) for i, v in enumerate(x)], "symbol string, ts timestamp, x double")
    got = [r.w_std_pop for r in scans.sliding_stats(df, "x", 50, chunk=256).orderBy("ts").collect()]
    for i in (3049, 3060, 3100, 3199):
        assert got[i] == pytest.approx(statistics.pstdev(x[i - 49 : i + 1]), rel=1e-8)
    assert got[-1] == 0.0 and got[-51] == 0.0


def test_one_long_series_is_many_tasks(spark):
    df = spark.range(300_000).select(F.lit("a").alias("symbol"), F.timestamp_seconds(F.col("id") * 20).alias("ts"), (F.col("id") * 7919 % 1000).cast("double").alias("x"))
    c = scans.in_chunks(df, 100, chunk=20_000)
    assert c.groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 20_100 and c.select("_chunk").distinct().count() >= 15
    assert c.filter("_mine").count() == 300_000


@pytest.mark.parametrize("kind", ["random", "ties", "hot", "few", "one", "nulls"])
def test_order_statistics(spark, kind):
    rng = random.Random(kind)
    draw = {
        "random": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.randint(0, 20)), "hot": lambda: 5.0 if rng.random() < 0.6 else rng.gauss(5, 1),
        "few": lambda: rng.random(), "one": lambda: rng.random(), "nulls": lambda: None,
    }[kind]
    n = {"few": 3, "one": 1}.get(kind, 3000)
    rows = [(s, draw() if rng.random() < 0.95 else None) for s in "abc" for _ in range(n)]
    df = spark.createDataFrame(rows, "symbol string, x double").repartition(4)
    points = (0.0, 0.01, 0.333, 0.5, 0.95, 0.999, 1.0)
    for r in scans.percentiles(df, "x", points, "symbol", extra=(F.max("x").alias("top"),)).collect():
        v = sorted(x for s, x in rows if s == r.symbol and x is not None)
        assert r.n == len(v) and r.top == (v[-1] if v else None)
        assert (r.q is None) == (not v)
        if v:
            assert r.q == pytest.approx([float(np.quantile(v, p)) for p in points], rel=1e-12, abs=1e-15)
    x = scans.order_statistics(df, "x", ["symbol"], lambda n: [F.lit(0), F.floor(n / 2), n + 7])
    for r in x.collect():
        v = sorted(x for s, x in rows if s == r.symbol and x is not None)
        if v:
            assert [r.at_0, r.at_1, r.at_2] == [v[0], v[len(v) // 2], v[-1]]
            assert [r.less_0, r.less_1] == [0, sum(y < v[len(v) // 2] for y in v)] and r.next_2 == v[-1]
    whole = scans.percentiles(df, "x", (0.5,)).first()
    every = [x for _, x in rows if x is not None]
    assert whole.n == len(every) and (whole.q is None or whole.q[0] == pytest.approx(float(np.median(every)), rel=1e-12))


def test_bands_are_percent_rank_and_ntile(spark):
    rng = random.Random(11)
    rows = [(s, T0 + dt.timedelta(seconds=i), None if rng.random() < 0.1 else float(rng.randint(0, hi)) if rng.random() < 0.7 else 3.0) for s, hi, n in (("a", 5, 700), ("b", 10**6, 701), ("c", 2, 2), ("d", 2, 1), ("e", 0, 50)) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double").repartition(4)
    df.createOrReplaceTempView("bands_in")
    want = spark.sql("select symbol, ts, percent_rank() over (partition by symbol order by x nulls last) pr from bands_in").selectExpr("symbol", "ts", "case when pr < 0.333 then 1 when pr < 0.667 then 2 else 3 end as band")
    got = scans.percent_rank_bands(df, "x", (0.333, 0.667))
    assert {(r.symbol, r.ts): r.band for r in got.collect()} == {(r.symbol, r.ts): r.band for r in want.collect()}
    for k in (2, 3, 7):
        want = spark.sql(f"select symbol, ts, ntile({k}) over (partition by symbol order by x, ts) tile from bands_in where x is not null")
        got = scans.ntile_bands(df, "x", k)
        assert {(r.symbol, r.ts): r.tile for r in got.collect()} == {(r.symbol, r.ts): r.tile for r in want.collect()}
    for plan in (scans.percent_rank_bands(df, "x", (0.333, 0.667)), scans.ntile_bands(df, "x", 3)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"percent_rank|\bntile|row_number", text)


def test_distribution_is_exact(spark):
    df, rows = walk(spark, 2000)
    for exact in (True, False):
        for r in windows.distribution(df, "x", "symbol", exact=exact).collect():
            v = [x for _, _, x in own(rows, r.symbol) if x is not None]
            want = [len(v), statistics.fmean(v), statistics.stdev(v), min(v), *np.quantile(v, (0.25, 0.5, 0.75)), max(v)]
            assert list(r)[1:] == pytest.approx(want, rel=1e-12 if exact else 5e-3)


def prices_with_jumps(rng, n):
    out, p = [], 100.0
    for _ in range(n):
        p *= math.exp(rng.gauss(0, 0.03))
        u = rng.random()
        if u < 0.05:
            p *= rng.choice((0.5, 0.75, 0.85, 1.2, 1.25, 1.4, 2.0))
        out.append(None if u > 0.97 else math.nan if u > 0.95 else 0.0 if u > 0.94 else math.inf if u > 0.93 else p * rng.choice((1.0, 1.0, 1.3, 0.7)) if u > 0.6 else p)
    return out


def is_sound(p):
    return p is not None and p == p and 0 < p < math.inf


@pytest.mark.parametrize("seed", range(6))
def test_effects_compose_to_the_fold(seed):
    """A day's effect, applied to any last price, is the fold from that price: for prices of other days, and for many made up."""
    rng = random.Random(seed)
    for _ in range(60):
        prices = prices_with_jumps(rng, rng.randint(1, 60))
        sound = [is_sound(p) for p in prices]
        fresh, ranges = folds.effect(prices, sound, 0.2)
        tries = [None, *(p * f for p in prices if is_sound(p) for f in (1.0, 0.8, 1.2, 1 / 1.2, 1.25, 0.9999, 1.0001)), *(math.exp(rng.uniform(0, 9)) for _ in range(60))]
        for last in tries:
            assert folds.apply_effect(last, fresh, ranges, 0.2) == folds.fold_from(last, prices, sound, 0.2)[0]


def test_effect_of_a_quiet_day_is_one_range():
    rng = random.Random(3)
    prices = [100 * math.exp(0.05 * math.sin(i / 200) + rng.gauss(0, 0.001)) for i in range(1440)]
    assert len(folds.effect(prices, [True] * 1440, 0.2)[1]) == 1


@pytest.mark.parametrize("ms", [60_000, 1_800_000, 86_400_000])
def test_validated_prices_are_the_plain_fold(spark, ms):
    rng = random.Random(ms)
    rows = [(s, T0 + dt.timedelta(seconds=40 * i), p) for s in "abc" for i, p in enumerate(prices_with_jumps(rng, 500))]
    rows += [("a", T0, 99.0), ("a", None, 100.0), ("d", T0, None)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, mark_price double").repartition(6)
    as_of = T0 + dt.timedelta(seconds=12_000)
    for limit in (None, as_of):
        want = []
        for s in "abcd":
            mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or T0, math.inf if not is_sound(r[2]) else r[2]))
            sound = [is_sound(p) and (limit is None or (t is not None and t <= limit + dt.timedelta(minutes=5))) for _, t, p in mine]
            want += [(s, t, ok) for (_, t, _), ok in zip(mine, folds.fold_from(None, [p for _, _, p in mine], sound, 0.2)[1], strict=True)]
        rule = quality.mark_price_sound(None if limit is None else F.lit(limit))
        got = folds.fold_prices(df, rule, ms=ms).collect()
        plain = lambda x: sorted(map(str, x))
        assert plain((r.symbol, r.ts, r.accepted) for r in got) == plain(want)
    none = folds.fold_prices(df.limit(0), quality.mark_price_sound())
    assert none.collect() == [] and none.columns == ["symbol", "ts", "mark_price", "accepted"]


def test_running_totals_and_previous_over_days(spark):
    """Sums and the row before, carried over days, gaps of days and null values."""
    import random

    rng = random.Random(7)
    rows = [(s, t, rng.choice([None, 0.0, rng.random()])) for s in "ab" for t in sorted(rng.sample(range(12 * 86_400_000), 60))]
    rows = [(s, t, v) for s, t, v in rows if not 3 * 86_400_000 <= t < 6 * 86_400_000]
    df = spark.createDataFrame(rows, "symbol string, ms long, v double").repartition(3)
    have = {(r.symbol, r.ms): r for r in scans.with_previous(df, "v", "last", ts="ms").collect()}
    totals = {(r.symbol, r.ms): r.t for r in scans.running_totals(df.fillna(0.0), {"t": "v"}).collect()}
    assert len(have) == len(totals) == len(rows)
    for s in "ab":
        last, total = None, 0.0
        for _, t, v in [r for r in rows if r[0] == s]:
            total += v or 0.0
            assert have[s, t].v == v and have[s, t].last == last and totals[s, t] == pytest.approx(total, rel=1e-12)
            last = v


def test_asof_spreads_sides_that_lie_by_key(spark):
    """A series whose two sides are already dealt by symbol is still worked on by several tasks."""
    from tidemark.operators.windows import asof_backward

    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(conf, "false")
    try:
        side = lambda name: spark.range(400).select(F.lit("a").alias("symbol"), (F.col("id") * 3_600_000).alias("ms"), F.col("id").alias(name)).repartition(4, "symbol")
        out = asof_backward(side("n"), side("v"), "v", left_ts="ms", right_ts="ms").select("n", "v", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset(conf)
    assert all(r.n == r.v for r in out) and len(out) == 400 and len({r.p for r in out}) > 1
