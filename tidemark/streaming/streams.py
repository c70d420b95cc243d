"""Structured Streaming forms: minute roll-up, liquidation feed, open interest, snapshots and alerts (stateful.py: validated marks, scores, late rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.merge import sane_funding, sane_oi
from tidemark.operators.quality import quote_rule
from tidemark.operators.serving import alerts, audience_match, audience_members, audiences, subscription_match, with_level
from tidemark.operators.windows import floor_index


def mark_minutes(ticks: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """Last price of each symbol and minute; late ticks past the watermark are dropped."""
    w = not_ahead(ticks).withWatermark("ts", watermark).groupBy("symbol", F.window("ts", "1 minute"))
    out = w.agg(F.max_by("mark_price", F.struct("ts", "event_id")).alias("mark_price"), F.count(F.lit(1)).alias("ticks"))
    return out.select("symbol", F.col("window.start").alias("ts"), "mark_price", "ticks")


def liquidations(events: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Sound liquidations, each id once within the watermark."""
    ok = (F.col("price") > 0) & (F.col("quantity") > 0) & F.col("side").isin("BUY", "SELL")
    out = not_ahead(events).filter(ok).withColumn("usd_value", F.col("price") * F.col("quantity"))
    return out.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["id"])


def parse_force_orders(raw: DataFrame) -> DataFrame:
    """id, symbol, side, price, quantity, ts from force-order JSON in ``value``; other messages are passed over.

    Fields are taken by path, as their names differ in case alone (e and E, s and S).
    """
    at = lambda path: F.get_json_object("value", path)
    x = raw.select(at("$.e").alias("kind"), at("$.o.s").alias("symbol"), at("$.o.S").alias("side"), at("$.o.ap").alias("ap"), at("$.o.z").alias("z"), at("$.o.T").alias("at"))
    x = x.filter("kind = 'forceOrder' and symbol is not null")
    return x.select(
        F.concat_ws(":", "symbol", "side", "at").alias("id"), "symbol", "side", F.expr("try_cast(ap as double)").alias("price"), F.expr("try_cast(z as double)").alias("quantity"), F.timestamp_millis(F.expr("try_cast(at as bigint)")).alias("ts")
    )


def not_ahead(rows: DataFrame, ts: str = "ts", minutes: int = 5) -> DataFrame:
    """Without rows that lie more than ``minutes`` in the future."""
    return rows.filter(F.unix_millis(ts) <= F.unix_millis(F.current_timestamp()) + minutes * 60_000)


def snapshots(quotes: DataFrame, every: str = "30 seconds", watermark: str = "1 minute", max_stale_ms: int = 15_000, **bounds) -> DataFrame:
    """Snapshot of each symbol per tumbling window: sound quotes, the latest of each venue, outliers out, totals, averages and signals.

    ``quotes`` has ts (arrival), quote_ts (the quote's own time) and event_id; ``bounds`` go to ``quality.quote_rule``.
    """
    sound = not_ahead(quotes).withWatermark("ts", watermark).filter(quote_rule(F.col("ts"), max_stale_ms=max_stale_ms, **bounds).isNull())
    values = F.struct("exchange", "mark_price", "funding_rate", "open_interest_usd")
    latest = sound.groupBy(F.window("ts", every), "symbol", "exchange").agg(F.max_by(values, F.struct("ts", "event_id")).alias("q"))
    v = latest.groupBy("window", "symbol").agg(F.array_sort(F.collect_list("q")).alias("q"))
    prices = F.array_sort(F.transform(F.filter("q", lambda q: q["mark_price"] > 0), lambda q: q["mark_price"]))
    v = v.withColumn("_p", prices).withColumn("_m", floor_index(F.col("_p"), 0.5))
    v = v.withColumn("_p", F.filter("_p", lambda p: (F.size("_p") < 2) | (F.abs(p - F.col("_m")) / F.col("_m") <= 0.5)))
    oi = F.transform(F.filter("q", lambda q: sane_oi(q["open_interest_usd"])), lambda q: q["open_interest_usd"])
    rates = F.transform(F.filter("q", lambda q: sane_funding(q["funding_rate"])), lambda q: q["funding_rate"])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    mean = lambda a: F.coalesce(total(a) / F.nullif(F.size(a), F.lit(0)), F.lit(0.0))
    out = v.select("symbol", F.col("window.start").alias("ts"), total(oi).alias("total_oi"), mean(rates).alias("avg_funding"), mean(F.col("_p")).alias("avg_mark"), F.size("q").alias("venues"), (F.array_max("_p") - F.array_min("_p")).alias("_r"))
    spread = F.coalesce(F.col("_r") / F.when(F.col("avg_mark") > 0, F.col("avg_mark")) * 100.0, F.lit(0.0))
    high = F.abs("avg_funding")
    severity = F.when(high > 0.002, "critical").when(high > 0.001, "high").when(high > 0.0005, "medium")
    return out.withColumn("spread_pct", F.when(spread > 50, 0.0).otherwise(spread)).withColumn("funding_signal", severity).drop("_r")


def open_interest_usd(reports: DataFrame, prices: DataFrame, watermark: str = "5 minutes") -> DataFrame:
    """(symbol, minute, ts, contracts, mark_price, open_interest_usd): the first report of each symbol and minute by the price of its minute.

    Both sides are streams, so a price that comes after the report joins it when it comes, and either side waits in state until the watermark
    (``watermark`` behind the slower of the two) has passed its minute. ``reports`` has symbol, ts, contracts; ``prices`` symbol, ts, mark_price.
    """
    minute = F.date_trunc("minute", "ts").alias("minute")
    left = not_ahead(reports).select("symbol", minute, "ts", "contracts").withWatermark("minute", watermark).dropDuplicatesWithinWatermark(["symbol", "minute"])
    right = not_ahead(prices).filter("mark_price > 0").select("symbol", minute, "mark_price").withWatermark("minute", watermark).dropDuplicatesWithinWatermark(["symbol", "minute"])
    usd = left.join(right, ["symbol", "minute"])
    return usd.select("symbol", "minute", "ts", "contracts", "mark_price", (F.col("contracts") * F.col("mark_price")).alias("open_interest_usd")).filter("open_interest_usd >= 0")


#: Tasks over which a batch's deliveries are spread: as many rows as subscriptions times alerts, of few symbols and levels.
DELIVERY_PARTS = 48

AUDIENCE = "audience string, symbols_csv string, min_level_ord int, subscription_ids array<long>"


def alerts_to_tables(scores: DataFrame, subscriptions: Callable[[SparkSession], DataFrame] | None, base: str, checkpoint: str, lists: bool = False) -> StreamingQuery:
    """Work off a stream of scores (symbol, time, risk_score) into ``base``/alerts and ``base``/deliveries, a folder a batch.

    ``subscriptions`` is read afresh for every batch, so a change counts from the next batch on; without it there are no deliveries. A batch that is
    run again, as after a failure, replaces its folders, so each alert and each delivery is there once. Deliveries are a row each, or with ``lists``
    a row for each alert and list of subscriptions it goes to; the lists, as they are for the batch, are in ``base``/audiences, and ``deliveries`` gives the single rows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        alerts(batch).write.mode("overwrite").parquet(f"{base}/alerts/batch={number}")
        if subscriptions and lists:
            upper = with_level(batch).filter(F.col("level").isin("critical", "high"))
            audiences(subscriptions(spark), "alert").write.mode("overwrite").parquet(f"{base}/audiences/batch={number}")
            to = spark.read.schema(AUDIENCE).parquet(f"{base}/audiences/batch={number}")
            audience_match(upper, to, keep=("time",), parts=DELIVERY_PARTS).write.mode("overwrite").parquet(f"{base}/deliveries/batch={number}")
        elif subscriptions:
            upper = with_level(batch).filter(F.col("level").isin("critical", "high"))
            subscription_match(upper, subscriptions(spark), "alert", keep=("time",), parts=DELIVERY_PARTS).write.mode("overwrite").parquet(f"{base}/deliveries/batch={number}")
        batch.unpersist()

    q = scores.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def deliveries(spark: SparkSession, base: str) -> DataFrame:
    """(subscription_id, symbol, level, risk_score, time): each delivery of the tables that ``alerts_to_tables`` wrote by lists."""
    matched = spark.read.schema("audience string, symbol string, level string, risk_score int, time timestamp, batch long").parquet(f"{base}/deliveries")
    lists = spark.read.schema(f"{AUDIENCE}, batch long").parquet(f"{base}/audiences")
    return audience_members(matched, lists, "batch", "audience")


def sliding_liquidations(liqs: DataFrame, size: str = "5 minutes", step: str = "1 minute", watermark: str = "10 minutes") -> DataFrame:
    w = liqs.withWatermark("ts", watermark).groupBy("symbol", F.window("ts", size, step))
    return w.agg(F.sum("usd_value").alias("usd"), F.count(F.lit(1)).alias("n")).select("symbol", F.col("window.start").alias("ts"), "usd", "n")


def first_per_key(rows: DataFrame, keys: list[str], watermark: str = "10 minutes") -> DataFrame:
    return not_ahead(rows).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def quality_counters(ticks: DataFrame, watermark: str = "2 minutes") -> DataFrame:
    """Ticks and rejected ticks per minute."""
    bad = ~(F.col("mark_price") > 0) | F.isnan("mark_price")
    w = ticks.withWatermark("ts", watermark).groupBy(F.window("ts", "1 minute"))
    return w.agg(F.count(F.lit(1)).alias("ticks"), F.count_if(bad).alias("rejected")).select(F.col("window.start").alias("ts"), "ticks", "rejected")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what is there and stop; the files are exactly-once by the checkpoint."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
