"""Streams with state: restarts, rows in any order within the watermark, late rows, both sides of a join, batches that run twice."""

import datetime as dt
import math
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, stress
from tidemark.streaming import stateful, streams

T0 = dt.datetime(2024, 1, 1)
MINUTE = dt.timedelta(minutes=1)


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def land(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_stress_restarts_and_bounded_state(spark, folder, monkeypatch):
    monkeypatch.setattr(stateful.StressScores, "BLOCK", 16)
    rng = random.Random(4)
    rows = [(s, T0 + i * MINUTE, rng.choice([abs(rng.gauss(0, 0.3)), 0.0, None, 0.25])) for i in range(400) for s in "ab"]
    schema, how = "symbol string, ts timestamp, deviation double", {"history": 90, "warm": 50, "lookback": 30}
    sizes, at = [], 0
    for n in (1, 1, 150, 3, 245):  # a start of the query each; within a part rows come in any order
        part = [r for r in rows if at <= (r[1] - T0) / MINUTE < at + n]
        at += n
        rng.shuffle(part)
        land(spark, part, schema, f"{folder}/in")
        q = stateful.stress_to_table(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/checkpoint", **how)
        sizes.append(q.lastProgress.stateOperators[0].numRowsTotal)
    names = ["symbol", "ts", "x", "regime", "warm", "level", "score"]
    have = {(r.symbol, r.ts): r for r in spark.read.parquet(f"{folder}/out").collect()}
    want = stress.stress_score(spark.createDataFrame(rows, schema), chunk=64, **how).collect()
    assert len(have) == len(want) == 800
    for w in want:
        h = have[w.symbol, w.ts]
        assert [h[n] for n in names] == [w[n] for n in names]
        for n in ("z", "vol_of_stress", "confidence", "pct_rank", "critical_at"):
            assert h[n] == pytest.approx(w[n], abs=1e-9)
    assert sizes[-1] <= 2 * (1 + 90 // 16 + 2), sizes


def test_validated_marks_in_any_order(spark, folder):
    """Rows shuffled by up to the watermark, in several batches, are the fold of the whole series."""
    rng = random.Random(7)
    price, rows = 100.0, []
    for i in range(300):
        price *= math.exp(rng.gauss(0, 0.04)) * (1.3 if rng.random() < 0.05 else 1.0)
        rows += [(s, T0 + i * MINUTE, p) for s in "ab" for p in ([price, price * 1.1] if rng.random() < 0.1 else [price if rng.random() > 0.03 else math.nan])]
    schema = "symbol string, ts timestamp, mark_price double"
    arriving = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=rng.uniform(0, 9)))
    for i in range(0, len(arriving), 120):
        land(spark, arriving[i : i + 120], schema, f"{folder}/in")
        with stateful.state_store(spark):
            streams.run_to_table(stateful.validated_marks(spark.readStream.schema(schema).parquet(f"{folder}/in"), watermark="10 minutes"), f"{folder}/out", f"{folder}/checkpoint")
    have = sorted((r.symbol, r.ts, r.mark_price) for r in spark.read.parquet(f"{folder}/out").collect())
    mark = max(r[1] for r in rows) - 10 * MINUTE
    want = []
    for s in "ab":
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], math.inf if r[2] != r[2] else r[2]))
        _, flags = folds.fold_from(None, [p for _, _, p in mine], [p == p for _, _, p in mine], 0.2)
        want += [r for r, ok in zip(mine, flags, strict=True) if ok and r[1] < mark]
    assert have == sorted(want) and len(want) > 150


def test_late_rows_add_up(spark, folder):
    schema = "symbol string, ts timestamp, _odd long, def long"
    at = lambda m: T0 + m * MINUTE
    far = dt.datetime.now() + dt.timedelta(hours=2)
    parts = [
        [("a", at(0), 1, 1), ("a", at(60), 2, 1), ("a", at(1), 3, 1), ("b", at(5), 4, 1), ("a", far, 5, 1)],
        [("a", at(57), 6, 1), ("a", at(59), 7, 1), ("a", at(57.99), 8, 1), ("b", at(3), 9, 1), ("b", at(2.5), 10, 1), ("c", at(-500), 11, 1), ("a", at(61), 12, 1), ("b", None, 13, 1)],
        [("a", at(59), 14, 1), ("a", at(58), 15, 1), ("c", far, 16, 1)],
    ]
    for part in parts:
        land(spark, part, schema, f"{folder}/in")
        stateful.arrivals_to_tables(spark.readStream.schema(schema).parquet(f"{folder}/in"), folder, f"{folder}/checkpoint", delay_ms=120_000)
    late = {r["_odd"]: r.arrival for r in spark.read.parquet(f"{folder}/late").collect()}
    taken = {r["_odd"] for r in spark.read.parquet(f"{folder}/taken").collect()}
    assert late == {5: "ahead", 16: "ahead", 6: "late", 8: "late", 10: "late", 13: "late", 15: "late"}
    assert taken == set(range(1, 17)) - set(late)
    counts = spark.read.parquet(f"{folder}/counts").groupBy("arrival").agg(F.sum("n")).collect()
    assert dict(map(tuple, counts)) == {"taken": 9, "late": 5, "ahead": 2}
    assert spark.read.parquet(f"{folder}/taken").drop("batch").columns == ["symbol", "ts", "_odd", "def"]


def test_open_interest_joins_late_prices(spark, folder):
    reports, prices = "symbol string, ts timestamp, contracts double", "symbol string, ts timestamp, mark_price double"
    at = lambda m, s=0: T0 + dt.timedelta(minutes=m, seconds=s)
    batches = [
        ([("a", at(0, 10), 2.0), ("a", at(0, 40), 9.0), ("b", at(1, 5), 3.0)], [("b", at(1), 10.0), ("b", at(1), 10.0)]),
        ([("a", at(2, 1), 5.0)], [("a", at(0), 100.0), ("a", at(3), 7.0)]),  # the price of minute 0 comes later
        ([("a", at(60, 1), 5.0)], [("a", at(60), 1.0), ("b", at(60), 1.0)]),  # the watermark moves past minute 50
        ([("a", at(61, 1), -1.0)], [("a", at(61), 1.0), ("a", at(2), 3.0)]),  # too late for minute 2
    ]
    kept = []
    for left, right in batches:
        land(spark, left, reports, f"{folder}/reports")
        land(spark, right, prices, f"{folder}/prices")
        stream = streams.open_interest_usd(spark.readStream.schema(reports).parquet(f"{folder}/reports"), spark.readStream.schema(prices).parquet(f"{folder}/prices"), "10 minutes")
        with stateful.state_store(spark):
            q = streams.run_to_table(stream, f"{folder}/out", f"{folder}/checkpoint")
        kept.append(sum(o.numRowsTotal for o in q.lastProgress.stateOperators))
    have = sorted((r.symbol, r.minute, r.open_interest_usd) for r in spark.read.parquet(f"{folder}/out").collect())
    assert have == [("a", at(0), 200.0), ("a", at(60), 5.0), ("b", at(1), 30.0)]
    assert kept[1] >= kept[0] > 0 and kept[3] <= 12, kept


def test_alerts_once_and_subscriptions_afresh(spark, folder):
    scores, subs = "symbol string, time timestamp, risk_score int", "subscription_id long, enabled boolean, events_csv string, symbols_csv string, min_level_ord int"
    land(spark, [(1, True, "alert", "", 4), (2, True, "risk", "", 0), (3, False, "alert", "", 0)], subs, f"{folder}/subs1")
    land(spark, [(1, True, "alert", "", 4), (4, True, "risk,alert", "a", 3)], subs, f"{folder}/subs2")
    current = [f"{folder}/subs1"]

    def run():
        stream = spark.readStream.schema(scores).parquet(f"{folder}/in")
        streams.alerts_to_tables(stream, lambda s: s.read.parquet(current[0]), folder, f"{folder}/checkpoint")

    land(spark, [("a", T0, 85), ("b", T0, 70), ("c", T0, 10)], scores, f"{folder}/in")
    run()
    current[0] = f"{folder}/subs2"
    land(spark, [("a", T0 + MINUTE, 61), ("b", T0 + MINUTE, 99)], scores, f"{folder}/in")
    run()

    def state():
        alerts = sorted((r.symbol, r.time, r.severity) for r in spark.read.parquet(f"{folder}/alerts").collect())
        out = sorted((r.subscription_id, r.symbol, r.time, r.level) for r in spark.read.parquet(f"{folder}/deliveries").collect())
        return alerts, out

    want = (
        [("a", T0, "critical"), ("a", T0 + MINUTE, "high"), ("b", T0, "high"), ("b", T0 + MINUTE, "critical")],
        [(1, "a", T0, "critical"), (1, "b", T0 + MINUTE, "critical"), (4, "a", T0 + MINUTE, "high")],
    )
    assert state() == want
    for f in os.listdir(f"{folder}/checkpoint/commits"):  # as if the second batch had failed after it had written
        if f in ("1", ".1.crc"):
            os.remove(f"{folder}/checkpoint/commits/{f}")
    run()
    assert state() == want


def test_landed_pages(spark, folder):
    """A stream over a folder in which files keep arriving gives what a table of it gives, and reads nothing twice."""
    import json

    from tidemark.sources import landed

    def page(venue, endpoint, symbol, payload, minute):
        return json.dumps({"venue": venue, "endpoint": endpoint, "symbol": symbol, "payload": payload if isinstance(payload, str) else json.dumps(payload), "ts": f"2024-01-01T00:{minute:02d}:00Z"})

    def binance(symbol, minute, mark="100", index="101"):
        return page("binance", "premiumIndex", symbol, {"markPrice": mark, "indexPrice": index, "lastFundingRate": "0.0001", "nextFundingTime": 1}, minute)

    oi = lambda symbol, minute: page("binance", "openInterest", symbol, {"openInterest": "5"}, minute)
    kraken = page("kraken", "tickers", None, {"tickers": [{"symbol": "PF", "openInterest": "2", "markPrice": "50", "indexPrice": "50", "fundingRate": "0.001", "fundingRatePrediction": "0"}]}, 3)
    files = [
        [binance("A", 0), "{not json", page("nowhere", "x", "A", {}, 0), kraken],
        [oi("A", 0), binance("B", 1), page("okx", "mark-price", None, {}, 1), page("okx", "mark-price", "C", "no payload", 1)],  # the other endpoint of the fetch at 0
        [oi("B", 1), binance("D", 2, mark="bad"), oi("D", 2), json.dumps({"venue": "okx", "endpoint": "mark-price", "symbol": "C", "payload": "{}"})],
        [binance("E", 59), oi("E", 59)],
    ]
    listings = spark.createDataFrame([("kraken", "PF", "K")], "venue string, listed string, symbol string")
    os.makedirs(f"{folder}/in")
    for i, lines in enumerate(files):
        with open(f"{folder}/in/part{i}.json", "w") as f:
            f.write("\n".join(lines))
        landed.land(spark, f"{folder}/in", listings, folder)
    landed.land(spark, f"{folder}/in", listings, folder)  # nothing new
    names = ["exchange", "symbol", "ts", "mark_price", "index_price", "open_interest", "open_interest_usd", "funding_rate"]
    table = landed.read_pages(spark, f"{folder}/in")
    quotes = sorted(map(str, landed.landed_quotes(table, listings).select(names).collect()))
    assert len(quotes) == 4
    stream = sorted(map(str, spark.read.parquet(f"{folder}/quotes").select(names).collect()))
    assert stream == [q for q in quotes if "symbol='E'" not in q]  # the watermark has not passed the last fetch
    faults = lambda df: sorted((r.file, r.fault, r.line) for r in df.collect())
    rejected = faults(spark.read.parquet(f"{folder}/rejected"))
    assert rejected == faults(landed.rejected_pages(table))
    assert [(f, x) for f, x, _ in rejected] == [("part0.json", "NOT_JSON"), ("part0.json", "UNKNOWN_VENUE"), ("part1.json", "NO_SYMBOL"), ("part1.json", "PAYLOAD_NOT_JSON"), ("part2.json", "NO_TIME")]


def test_upsert_needs_its_partition_as_a_key(spark, folder):
    from tidemark.sources import tables

    with pytest.raises(ValueError, match="day"):
        tables.upsert_partitions(spark.range(1).withColumn("day", F.lit(1)), folder, ["id"], "id", "day")


def test_waiting_fetches_lie_in_rocksdb_as_numbers(spark, folder):
    from tidemark.sources import landed, venues

    spark.createDataFrame([("gateio", "contract", "A", '{"mark_price": "100", "index_price": "101"}', 0)], "venue string, endpoint string, symbol string, payload string, s int").selectExpr(
        "venue", "endpoint", "symbol", "payload", "timestamp_seconds(s) as ts"
    ).write.json(f"{folder}/in")
    listings = spark.createDataFrame([("kraken", "PF", "K")], "venue string, listed string, symbol string")
    landed.land(spark, f"{folder}/in", listings, folder)
    held = [f for _, _, names in os.walk(f"{folder}/checkpoint-quotes/state") for f in names]
    assert any(f.endswith((".changelog", ".zip")) for f in held) and not any(f.endswith(".delta") for f in held)
    fields = venues.fields_of_pages(landed.read_pages(spark, f"{folder}/in"), listings)
    assert {x.dataType.simpleString() for x in fields.schema["p"].dataType} == {"double"}


def test_listing_pages_do_not_grow_with_the_table(spark):
    from tidemark.plans.serving_queries import made_pages

    ticks = spark.range(0, 400_000, 100).selectExpr("id * 11 + 7 as event_id", "timestamp'2024-01-01' as ts", "'s' as symbol", "1.0D as open_interest_usd", "1.0D as mark_price", "1.0D as index_price", "0.0D as funding_rate")
    pages, listings = made_pages(ticks)
    sizes = [r[0] for r in pages.select(F.size(F.from_json("payload", "struct<tickers:array<string>>")["tickers"])).collect()]
    assert len(sizes) == 44 and max(sizes) < 100 and sum(sizes) == listings.count() == 4000
