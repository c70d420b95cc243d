"""Every registered library query against its DuckDB statement on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from tidemark.plans.registry import FLAGSHIP, ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    return float(v) if isinstance(v, Decimal) else v


def key(row):
    return tuple("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in row)


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    r = duck.execute(ORACLES[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(map(plain, x)) for x in r.fetchall()), key=key)
    got = sorted((tuple(plain(x[c]) for c in cols) for x in df.collect()), key=key)
    assert len(got) == len(want)
    bad = [(a, b) for a, b in zip(got, want) if not all(map(same, a, b))]
    assert not bad, bad[:2]


#: Queries without a statement, each with the test of its own rows.
TESTED = {"detect_cascades", "factors", "fit_calibration", "stress_score", "stress_predictions", "stream_mark_validated", "stream_stress", "walk_forward"}


def test_every_query_without_statement_has_a_test():
    assert set(QUERIES) - set(ORACLES) == TESTED


def folded(rows, max_jump=0.2):
    """(symbol, ts_us, price) in order of time, and whether each is within the jump of the last accepted one."""
    last, out = {}, {}
    for s, us, p in sorted(rows):
        ok = p is not None and p == p and 0 < p < math.inf and (s not in last or abs(p - last[s]) / last[s] <= max_jump)
        if ok:
            last[s] = p
        out[s, us] = (ok, p)
    return out


def test_validated_marks_batch_and_stream(spark, sf, duck):
    rows = duck.execute("select event_type, epoch_us(ts), 100 + (100.0 + value / 20.0 - 100) * 20 from events").fetchall()
    want = folded(rows)
    as_of = 1_706_184_000_000_000  # 2024-01-25 12:00
    early = folded([r for r in rows if r[1] // 1000 <= as_of // 1000 + 300_000])
    batch = QUERIES["validate_mark_prices"](spark, sf).collect()
    assert {(r.symbol, r.ts_us): r.accepted for r in batch} == {k: k in early and early[k][0] for k in want}
    end = max(us for _, us, _ in rows) - 120_000_000
    stream = {(r.symbol, r.ts_us): r.mark_price for r in QUERIES["stream_mark_validated"](spark, sf).collect()}
    due = {k: p for k, (ok, p) in want.items() if ok and k[1] // 1000 < end // 1000}
    assert set(due) == {k for k in stream if k[1] // 1000 < end // 1000} and all(math.isclose(stream[k], p, abs_tol=1e-5) for k, p in due.items())
    assert 0 < len(due) < len(want)


def test_stream_stress_is_the_batch_score(spark, sf):
    from pyspark.sql import functions as F

    from tidemark.operators import stress
    from tidemark.plans.fixtures import frame

    x = frame(spark, sf, "ticks").groupBy("symbol", F.date_trunc("hour", "ts").alias("ts")).agg(((F.max("mark_price") - 100.0) / 2.5).alias("deviation"))
    want = {(r.symbol, r.ts): r for r in stress.stress_score(x, history=120, warm=60, lookback=48, chunk=120).withColumn("ts", F.unix_millis("ts")).collect()}
    have = QUERIES["stream_stress"](spark, sf).collect()
    assert len(have) == len(want)
    for r in have:
        w = want[r.symbol, r.ts]
        assert (r.level, r.regime, r.warm) == (w.level, w.regime, w.warm) and math.isclose(r.z, w.z, abs_tol=2e-6) and abs(r.score - w.score) <= 0


def test_stress_predictions(spark, sf):
    rows = QUERIES["stress_predictions"](spark, sf).collect()
    assert {r.direction is not None for r in rows} == {True, False}
    for r in rows:
        assert (r.direction is None) == (r.score < 40)
        if r.score < 40:
            continue
        distance, up = max(2.0, 6.0 - r.score / 100 * 4.0), r.funding_rate <= 0
        assert r.direction == ("short_squeeze" if up else "long_squeeze")
        assert math.isclose(r.probability, min(0.95, max(0.05, 1 / (1 + math.exp(7 - 0.1 * r.score)))), abs_tol=1e-5)
        assert math.isclose(r.trigger_price, r.index_price * (1 + distance / 100 if up else 1 - distance / 100), abs_tol=1e-4)
        assert math.isclose(r.estimated_impact, r.open_interest_usd * (0.03 + r.score / 100 * 0.07), rel_tol=1e-9)
        assert r.time_window == ("1-4 hours" if abs(r.z) >= 3 else "4-12 hours" if abs(r.z) >= 2 else "12-24 hours")


def test_walk_forward(spark, sf):
    """The curve is fitted on rows before the cut alone; Brier score, base rate and skill are those of the rows after it."""
    from pyspark.sql import functions as F

    from tidemark.operators import research
    from tidemark.plans.fixtures import frame
    from tidemark.plans.market import MID, as_of, labelled

    rows = labelled(lambda name: frame(spark, sf, name)).withColumn("before", F.col("time") < as_of(MID)).cache()
    fitted = {r.symbol: r for r in research.fit_calibration(research.calibration_bins(rows.filter("before"), "symbol"), "symbol").collect()}
    after, want = rows.filter("not before").select("symbol", "risk_score", "actual").collect(), {}
    for symbol, w in fitted.items():
        own = [(1 / (1 + math.exp(-(w.intercept + w.slope * r.risk_score))), r.actual) for r in after if r.symbol == symbol]
        rate = sum(y for _, y in own) / len(own)
        brier, base = sum((p - y) ** 2 for p, y in own) / len(own), rate * (1 - rate)
        want[symbol] = (brier, base)
    have = {r.symbol: r for r in QUERIES["walk_forward"](spark, sf).collect()}
    assert set(have) == set(want) and want
    for symbol, (brier, base) in want.items():
        r = have[symbol]
        assert math.isclose(r.brier, brier, abs_tol=2e-6) and math.isclose(r.climatology, base, abs_tol=2e-6)
        assert base == 0 or math.isclose(r.skill, 1 - brier / base, abs_tol=2e-5)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0 and FLAGSHIP in __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
