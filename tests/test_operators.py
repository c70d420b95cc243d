"""Operators that SQL cannot restate, against plain Python on small inputs; and invariants."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import detect, quality, research, stress, windows
from tidemark.sources import tables
from tidemark.streaming import streams

T0 = dt.datetime(2024, 1, 1)


def at(ms):
    return T0 + dt.timedelta(milliseconds=ms)


def series(spark, n=400, seed=3, step=60_000, name="mark_price", jitter=0):
    rng = random.Random(seed)
    rows = []
    for s in ("a", "b"):
        p, ms = 100.0, 17_300
        for i in range(n):
            p *= math.exp(rng.gauss(0, 0.004) * (6 if rng.random() < 0.04 else 1))
            rows.append((s, at(ms), p))
            ms += step + rng.randint(0, jitter)
    return spark.createDataFrame(rows, f"symbol string, ts timestamp, {name} double"), rows


def quantile(v, q):
    return float(np.quantile(v, q))


def test_prefix_stats_match_a_sliding_frame(spark):
    df, rows = series(spark)
    for current in (True, False):
        got = {(r.symbol, r.ts): r for r in windows.prefix_stats(df, "mark_price", 50, include_current=current).collect()}
        for s in ("a", "b"):
            own = [(t, p) for x, t, p in rows if x == s]
            for i, (t, _) in enumerate(own):
                w = [p for _, p in (own[max(0, i - 49) : i + 1] if current else own[max(0, i - 50) : i])]
                r = got[s, t]
                assert r.w_n == len(w)
                if w:
                    assert r.w_mean == pytest.approx(statistics.fmean(w), rel=1e-9)
                    assert r.w_std_pop == pytest.approx(statistics.pstdev(w), abs=1e-6)


def test_halo_chunks_match_whole_windows(spark):
    df, rows = series(spark, 200)
    got = {(r.symbol, r.ts): r for r in windows.rolling_order_stats(df, "mark_price", 40, (0.9,), chunk=17, rank=True).collect()}
    assert len(got) == len(rows)
    for s in ("a", "b"):
        own = [(t, p) for x, t, p in rows if x == s]
        for i, (t, p) in enumerate(own):
            w = [v for _, v in own[max(0, i - 39) : i + 1]]
            assert got[s, t].mark_price_q90 == pytest.approx(quantile(w, 0.9), rel=1e-12)
            assert got[s, t].mark_price_rank == pytest.approx(sum(v <= p for v in w) / len(w) * 100)


def brute_stress(values, history, warm, lookback):
    out, zs = [], []
    for i, x in enumerate(values):
        w = values[max(0, i - history + 1) : i + 1]
        sd = statistics.pstdev(w)
        z = (x - statistics.fmean(w)) / sd if sd > 1e-12 else 0.0
        if i:
            zs.append(z)
        zw = zs[-history:]
        vol = statistics.pstdev(zs[-lookback:]) if zs else 0.0
        regime = "MEDIUM"
        if len(zw) >= 60:
            regime = "LOW" if vol < quantile(zw, 0.33) else "HIGH" if vol > quantile(zw, 0.67) else "MEDIUM"
        m = {"LOW": 0.75, "MEDIUM": 1.0, "HIGH": 1.5}[regime]
        if i + 1 >= warm:
            score, limits = (z if i else 0.0) * 20, [quantile(w, q) * m for q in (0.9, 0.95, 0.99)]
        else:
            limits = [0.15, 0.3, 0.6]
            score = 0 if x <= 0 else x / 0.15 * 40 if x < 0.15 else 40 + (x - 0.15) / 0.15 * 20 if x < 0.3 else 60 + (x - 0.3) / 0.3 * 20 if x < 0.6 else min(100, 80 + (x / 0.6 - 1) * 20)
        level = "critical" if x >= limits[2] else "high" if x >= limits[1] else "elevated" if x >= limits[0] else "moderate" if score >= 20 else "low"
        out.append((level, regime, min(100, max(0, math.floor(score + 0.5))), z if i else 0.0))
    return out


def test_stress_score(spark):
    rng = random.Random(5)
    rows = [("a", at(i * 60_000), abs(rng.gauss(0, 0.3))) for i in range(260)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, deviation double")
    got = stress.with_factors(stress.stress_score(df, history=120, warm=50, lookback=30, chunk=64)).orderBy("ts").collect()
    want = brute_stress([r[2] for r in rows], 120, 50, 30)
    assert [(r.level, r.regime, r.score) for r in got] == [w[:3] for w in want]
    assert all(abs(r.z - w[3]) < 1e-6 for r, w in zip(got, want))
    assert all(len(r.factors) == 3 for r in got)


def brute_detect(prices, liqs, window, k, lookback, floor_usd, dominance):
    out = []
    for s in sorted({p[0] for p in prices}):
        own = sorted(((t - T0) / dt.timedelta(milliseconds=1), p) for x, t, p in prices if x == s)
        mine = [((t - T0) / dt.timedelta(milliseconds=1), side, usd) for x, t, side, usd in liqs if x == s]

        def price(ms, own=own):
            if ms <= own[0][0]:
                return own[0][1]
            if ms >= own[-1][0]:
                return own[-1][1]
            for (a, p), (b, q) in zip(own, own[1:]):
                if a <= ms <= b:
                    return p if ms == a else p + (q - p) * (ms - a) / (b - a)

        def usd(a, b, side=None, mine=mine):
            return sum(v for t, x, v in mine if a <= t < b and side in (None, x))

        lo, hi, cands, t = own[0][0], own[-1][0], [], own[0][0]
        while t + window * 60_000 <= hi:
            end = t + window * 60_000
            rets = [math.log(q / p) for (_, p), (b, q) in zip(own, own[1:]) if t - lookback * 60_000 <= b <= t]
            sigma = math.sqrt(sum(r * r for r in rets) / len(rets)) * math.sqrt(525_960) if len(rets) >= 30 else 0
            buckets = [usd(t - (i + 1) * window * 60_000, t - i * window * 60_000) for i in range(lookback // window)]
            # Minutes before the lookback of the first price hold nothing to compare with.
            limit = max(floor_usd, quantile(buckets[: int((t - lo) / 60_000 + lookback) // window], 0.95) if (t - lo) / 60_000 + lookback >= 10 * window else 0)
            move, total = (price(end) - price(t)) / price(t), usd(t, end)
            long_, short = usd(t, end, "SELL"), usd(t, end, "BUY")
            if sigma and abs(move) >= k * sigma * math.sqrt(window / 525_960) and total >= limit and (total == 0 or max(long_, short) / total >= dominance):
                cands.append([t, end, "LONG_SQUEEZE" if long_ > short else "SHORT_SQUEEZE"])
            t += 60_000
        merged = []
        for c in cands:
            if merged and c[0] <= merged[-1][1] and c[2] == merged[-1][2]:
                merged[-1][1] = max(merged[-1][1], c[1])
            else:
                merged.append(c)
        out += [(s, d, round(a), round(b), round((price(b) - price(a)) / price(a) * 100, 6), round(usd(a, b), 3)) for a, b, d in merged]
    return sorted(out)


def test_detect_cascades(spark):
    df, prices = series(spark, 360, step=59_000, jitter=2000)
    rng = random.Random(9)
    liqs = [(s, at(rng.randint(-3_000_000, 21_000_000)), rng.choice(("BUY", "SELL", "SELL")), rng.expovariate(1 / 500)) for s in ("a", "b") for _ in range(900)]
    frame = spark.createDataFrame(liqs, "symbol string, ts timestamp, side string, usd_value double")
    how = {"window": 5, "k": 1.0, "lookback": 60, "floor_usd": 100.0, "dominance": 0.65}
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    got = sorted((r.symbol, r.direction, r.start_ms - base, r.end_ms - base, round(r.price_change_pct, 6), round(r.liquidation_usd, 3)) for r in detect.detect_cascades(df, frame, **how).collect())
    want = brute_detect(prices, liqs, **how)
    assert len(want) > 5 and got == want


def test_validate_mark_prices(spark):
    rng = random.Random(2)
    rows = [(s, at(i * 60_000), rng.choice([100.0, 105.0, 130.0, 90.0, -1.0, float("nan"), None])) for s in ("a", "b") for i in range(80)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, mark_price double")
    want = {}
    for s in ("a", "b"):
        last = None
        for x, t, p in rows:
            if x == s:
                ok = p is not None and p == p and p > 0 and (last is None or abs(p - last) / last <= 0.2)
                last = p if ok else last
                want[s, t] = ok
    for f in (quality.validate_mark_prices,):
        assert {(r.symbol, r.ts): r.accepted for r in f(df).collect()} == want


def test_fit_calibration(spark):
    rng = random.Random(4)
    rows = [(m, float(s), n := rng.randint(20, 60), sum(rng.random() < 1 / (1 + math.exp(-(-4 + 0.06 * s))) for _ in range(n))) for m in ("x", "y") for s in range(0, 101, 5)]
    rows += [("none", 10.0, 50, 0)]
    got = {r.model: r for r in research.fit_calibration(spark.createDataFrame(rows, "model string, centre double, total long, positive long"), "model").collect()}
    for m in ("x", "y"):
        w = np.zeros(2)
        x = np.array([(1, r[1]) for r in rows if r[0] == m])
        n, y = (np.array([r[i] for r in rows if r[0] == m], float) for i in (2, 3))
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ w))
            h = (x.T * (n * p * (1 - p))) @ x + 0.001 * np.eye(2)
            w = w + np.linalg.solve(h, x.T @ (y - n * p) - 0.001 * w)
        assert (got[m].intercept, got[m].slope) == pytest.approx(tuple(w), rel=1e-9) and got[m].converged
        assert got[m].var_b == pytest.approx(np.linalg.inv(h)[1, 1], rel=1e-6)
    assert (got["none"].intercept, got["none"].slope, got["none"].var_a) == (-5.0, 0.1, None)


def test_confusion_adds_up_and_recall_falls(spark):
    rows = [(i % 101, random.Random(i).random() < i % 101 / 150) for i in range(2000)]
    df = spark.createDataFrame(rows, "risk_score int, actual boolean").withColumn("symbol", F.lit("a"))
    curve = research.pr_curve(df, "symbol").orderBy("threshold").collect()
    assert all(r.tp + r.fp + r.tn + r.fn == 2000 for r in curve)
    assert all(a.recall >= b.recall for a, b in zip(curve, curve[1:])) and curve[0].recall == 1


def test_append_twice_is_append_once(spark):
    path = spark.conf.get("spark.checkpoint.dir") + "/append-test"
    df = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 3)], "k int, v string, seq int")
    assert tables.append_idempotent(df, path, ["k"], "seq") == 2
    assert tables.append_idempotent(df, path, ["k"], "seq") == 0
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "x", 1), (2, "z", 3)]


def test_upsert_writes_touched_partitions_alone(spark):
    path = spark.conf.get("spark.checkpoint.dir") + "/upsert-test"
    first = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, "x", 1), ("b", 1, "x", 1)], "day string, k int, v string, seq int")
    tables.upsert_partitions(first, path, ["day", "k"], "seq", "day")
    before = {r.f: r.n for r in spark.read.parquet(path).filter("day = 'b'").groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()}
    for _ in range(2):  # the second time changes nothing
        tables.upsert_partitions(spark.createDataFrame([("a", 2, "y", 2), ("a", 2, "z", 3), ("a", 3, "n", 1)], first.schema), path, ["day", "k"], "seq", "day")
        have = sorted((r.day, r.k, r.v) for r in spark.read.parquet(path).collect())
        assert have == [("a", 1, "x"), ("a", 2, "z"), ("a", 3, "n"), ("b", 1, "x")]
    assert before == {r.f: r.n for r in spark.read.parquet(path).filter("day = 'b'").groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()}


def test_asof_ties(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5)], "symbol string, ts long")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 15, None), ("a", 21, 3.0)], "symbol string, ts long, v double")
    assert sorted(tuple(r) for r in windows.asof_backward(left, right, "v").collect()) == [("a", 10, 1.0), ("a", 20, None), ("b", 5, None)]
    assert sorted((r.symbol, r.ts, r.v) for r in windows.asof_forward(left, right, "v").collect() if r.symbol == "a") == [("a", 10, 1.0), ("a", 20, 3.0)]


def test_force_orders(spark):
    good = '{"e":"forceOrder","E":1,"o":{"s":"BTC","S":"SELL","ap":"10.5","z":"2","T":1704067200000}}'
    raw = spark.createDataFrame([(good,), ('{"e":"other"}',), ("junk",)], "value string")
    assert [(r.id, r.price, r.quantity) for r in streams.parse_force_orders(raw).collect()] == [("BTC:SELL:1704067200000", 10.5, 2.0)]


def test_factors(spark):
    from tidemark.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["factors"](spark, sf).collect()
    scores = {(r.symbol, r.ts): r for r in QUERIES["stress_score"](spark, sf).collect()}
    assert len(rows) == 3 * len(scores)
    for r in rows:
        s = scores[r.symbol, r.ts_ms]
        if r.name == "Price Stress":
            assert (r.score, r.weight) == (s.score, 1.0) and abs(r.value - s.z) < 1e-5 and abs(r.threshold - s.critical_at) < 1e-5
        else:
            assert (r.score, r.weight) == (0, 0.0)
        if r.name == "Volatility Regime":
            assert r.description.startswith(f"Regime: {s.regime}, vol-of-stress=")
