"""Deliveries of few symbols are spread over tasks; a run without subscriptions writes alerts alone."""

import datetime as dt
import glob
import os
import tempfile

from pyspark.sql import functions as F

from tidemark.operators.serving import audiences, subscription_match, with_level
from tidemark.streaming import streams

SCORES, SUBS = "symbol string, time timestamp, risk_score int", "subscription_id long, enabled boolean, events_csv string, symbols_csv string, min_level_ord int"


def landed(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), 60 + i % 40) for i in range(300)]
    spark.createDataFrame(rows, SCORES).coalesce(1).write.parquet(f"{folder}/in")
    subs = spark.createDataFrame([(i, i % 5 > 0, "risk,alert" if i % 2 else "alert", ("", "a,b", "b")[i % 3], i % 5) for i in range(60)], SUBS)
    return folder, subs, spark.readStream.schema(SCORES).parquet(f"{folder}/in")


def test_deliveries_of_one_symbol_are_spread(spark):
    folder, subs, stream = landed(spark)
    streams.alerts_to_tables(stream, lambda s: subs, folder, f"{folder}/checkpoint")
    have = spark.read.parquet(f"{folder}/deliveries")
    upper = with_level(spark.read.parquet(f"{folder}/in")).filter(F.col("level").isin("critical", "high"))
    want = subscription_match(upper, subs, "alert", keep=("time",)).select("subscription_id", "symbol", "level", "risk_score", "time")
    assert sorted(map(tuple, have.drop("batch").select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert len(glob.glob(f"{folder}/deliveries/batch=0/*.parquet")) > 20


def test_deliveries_by_lists(spark):
    """A row for each alert and list of subscriptions, from which come all deliveries, also those of a subscription that is there twice."""
    folder, subs, stream = landed(spark)
    subs = subs.unionByName(subs.filter("subscription_id % 7 = 1")).unionByName(spark.createDataFrame([(100, True, "alert", None, 0), (101, True, "alert", "a", None)], SUBS))
    streams.alerts_to_tables(stream, lambda s: subs, folder, f"{folder}/checkpoint", lists=True)
    have = streams.deliveries(spark, folder)
    upper = with_level(spark.read.parquet(f"{folder}/in")).filter(F.col("level").isin("critical", "high"))
    want = subscription_match(upper, subs, "alert", keep=("time",)).select(have.columns)
    want = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, have.collect())) == want
    written = spark.read.parquet(f"{folder}/deliveries").count()
    assert len(want) > 2.5 * written


def test_lists_of_bounded_size(spark):
    subs = spark.range(1000).selectExpr("id as subscription_id", "true as enabled", "'alert' as events_csv", "'a' as symbols_csv", "0 as min_level_ord")
    lists = audiences(subs, "alert", size=100).collect()
    assert sorted(i for r in lists for i in r.subscription_ids) == list(range(1000))
    assert len({r.audience for r in lists}) == len(lists) == 10 and max(len(r.subscription_ids) for r in lists) < 150


def test_alerts_alone(spark):
    folder, _, stream = landed(spark)
    streams.alerts_to_tables(stream, None, folder, f"{folder}/checkpoint")
    assert spark.read.parquet(f"{folder}/alerts").count() == 300
    assert not os.path.exists(f"{folder}/deliveries")


def test_one_timer_and_entries_by_the_hour(spark):
    """A symbol's state is an entry for each waiting hour, not for each row, and a batch of many rows is worked off."""
    from tidemark.streaming import stateful

    folder, schema = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "symbol string, ts timestamp, mark_price double"
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * i), 100.0 + i % 5) for i in range(2000)]
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/in")
    with stateful.state_store(spark):
        q = streams.run_to_table(stateful.validated_marks(spark.readStream.schema(schema).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/checkpoint")
    have = sorted((r.symbol, r.ts, r.mark_price) for r in spark.read.parquet(f"{folder}/out").collect())
    assert have == [r for r in rows if r[1] < rows[-1][1] - dt.timedelta(minutes=2)]
    assert max(p.stateOperators[0].numRowsUpdated for p in q.recentProgress if p.stateOperators) < 100
