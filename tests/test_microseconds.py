"""Rows of one millisecond, and rates beyond the bounds: queries against their statements on small tables made for it."""

import datetime as dt
import tempfile

import duckdb
import pytest

from tidemark.plans.registry import ORACLES, QUERIES

T0 = dt.datetime(2024, 1, 5)


def tables(spark, rows):
    """events (event_id, ts, user_id, event_type, value) in a folder, and DuckDB over it."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    duck = duckdb.connect()
    duck.execute("set TimeZone = 'UTC'")
    duck.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double)")
    duck.executemany("insert into events values (?, ?, ?, ?, ?)", rows)
    duck.execute(f"copy events to '{folder}/events.parquet'")
    return folder, duck


def check(spark, rows, name):
    folder, duck = tables(spark, rows)
    r = duck.execute(ORACLES[name])
    cols = [d[0] for d in r.description]
    want = sorted(map(str, (tuple(x) for x in r.fetchall())))
    got = sorted(str(tuple(x[c] for c in cols)) for x in QUERIES[name](spark, folder).collect())
    assert got == want
    return got


us = lambda n, **more: T0 + dt.timedelta(microseconds=n, **more)


def test_duplicates_within_a_millisecond(spark):
    rows = [(10, us(100), 1, "a", 1.0), (11, us(900), 1, "a", 2.0), (12, us(1100), 1, "a", 3.0), (13, us(1200), 1, "b", 3.0)]
    assert check(spark, rows, "pk_duplicates") == [f"('a', {int(T0.replace(tzinfo=dt.timezone.utc).timestamp() * 1000)}, 3)"]


def test_liquidations_before_the_start_within_its_millisecond(spark):
    rows = [(1, us(100), 1, "a", 10.0), (2, us(900), 1, "a", 70.0), (3, us(850, minutes=30), 1, "a", 30.0), (4, us(950, minutes=30), 1, "a", 50.0), (5, us(900, minutes=30), 2, "a", 20.0)]
    check(spark, rows, "liq_in_window")


@pytest.mark.parametrize("over", [0, 300])
def test_lead_of_an_hour_to_the_microsecond(spark, over):
    """An alert at minute 0 and a start an hour and some microseconds after it."""
    rows = [(1, us(5), 1, "click", 90.0)] + [(2 + i, us(7, minutes=10 + i), 1, "click", 5.0 + 50.0 * (i % 2)) for i in range(40)] + [(90, us(over, hours=1), 1, "click", 90.0)]
    check(spark, rows, "lead_time")


def test_verdict_where_every_score_has_a_cascade_ahead(spark):
    rows = [(i, us(40, seconds=100 * i), i, "click", 80.0 if i % 3 == 2 else 5.0) for i in range(90)]
    (row,) = check(spark, rows, "research_verdict")
    assert "BSS=-inf" in row


def test_verdict_prints_the_binary_value(spark):
    """A lead of 0.25 minutes is 0.2 and one of 0.35 is 0.3, as C prints them."""
    for lead, text in ((15, "Lead time of 0.2 minutes"), (21, "Lead time of 0.3 minutes")):
        rows = [(1, us(0), 1, "click", 90.0)] + [(2, us(0, minutes=5, seconds=lead), 1, "click", 90.0), (3, us(0, minutes=5), 1, "click", 60.0), (4, us(0, hours=3), 1, "click", 1.0)]
        rows[0] = (1, us(0), 1, "click", 5.0)
        (row,) = check(spark, rows, "research_verdict")
        assert text in row


@pytest.mark.parametrize("over", [0, 300])
def test_cascade_in_horizon_to_the_microsecond(spark, over):
    check(spark, [(1, us(5), 1, "click", 5.0), (2, us(over, minutes=10), 1, "click", 90.0)], "cascade_in_horizon")


def test_interpolation_at_a_half(spark):
    """A price of 101.2039215, whose double lies a little below."""
    rows = [(1, us(0), 1, "a", 10.0), (2, us(0, milliseconds=3_600_000 - 849), 1, "a", 14.68), (3, us(0, milliseconds=3_600_000 + 1151), 1, "a", 36.82)]
    check(spark, rows, "interpolate_price")


def test_interpolation_between_rows_of_one_millisecond(spark):
    """The last of several before a point, the first of several after it, in whatever order and files they come."""
    before = [(10 + i, us(100 * i, minutes=59), 1, "a", 20.0 + i) for i in range(9)]
    after = [(30 + i, us(100 * i, minutes=61), 1, "a", 60.0 + i) for i in range(9)]
    rows = [(1, us(0), 1, "a", 10.0), *before, *after]
    for mixed in (rows, rows[::-1], rows[::2] + rows[1::2]):
        got = sorted(tuple(r) for r in QUERIES["interpolate_price"](spark, tables(spark, mixed)[0]).collect())
        assert [r[2] for r in got] == [100.5, 102.2]


def test_snapshot_with_a_high_rate(spark):
    rows = [(20 * i, us(0, seconds=5 * i), i, "a", 540.0 if i % 7 == 3 else 40.0 + i) for i in range(100)]
    assert check(spark, rows, "stream_snapshot")


def test_snapshot_with_an_average_at_a_half(spark):
    """Averages of four rates that lie at a half of the seventh digit."""
    sets = ((44.8, 16.5, 67.34, 89.49), (25.49, 90.89, 21.71, 45.04))
    rows = [(20 * (4 * i + j), us(0, minutes=i, seconds=j), j, "a", v) for i, values in enumerate(sets) for j, v in enumerate(values)]
    check(spark, [*rows, (400, us(0, minutes=10), 1, "a", 40.0)], "stream_snapshot")


def test_backward_jumps_do_not_depend_on_the_order_of_rows(spark):
    rows = [(i + 10_007 * k, us(0, seconds=(i * 37 + k * 11) % 101), 1, "a", 1.0) for i in range(50) for k in range(5)]
    results = [sorted(map(tuple, QUERIES["backward_jumps"](spark, tables(spark, r)[0]).collect())) for r in (rows, rows[::-1])]
    assert results[0] == results[1]
