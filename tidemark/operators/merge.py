"""Quotes of many venues to one snapshot per batch and symbol, and what is read off a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.windows import floor_index

B = ["batch_ts", "symbol"]


def merge_quotes(open_interest: DataFrame, funding: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per (batch, symbol, exchange) from three families; the first record of a family (by ``ord``) wins. One shuffle."""
    parts = [
        open_interest.select(*B, "exchange", F.struct("ord", "open_interest_usd").alias("oi")),
        funding.select(*B, "exchange", F.struct("ord", "funding_rate").alias("fr")),
        marks.select(*B, "exchange", F.struct("ord", "mark_price", "index_price").alias("mk")),
    ]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    first = both.groupBy(*B, "exchange").agg(F.min("oi").alias("oi"), F.min("fr").alias("fr"), F.min("mk").alias("mk"))
    return first.select(*B, "exchange", "oi.open_interest_usd", "fr.funding_rate", "mk.mark_price", "mk.index_price")


def sane_oi(c: Column) -> Column:
    return (c > 0) & (c < 5e11)


def sane_funding(c: Column) -> Column:
    return (c != 0) & (F.abs(c) < 0.01)


def exact_avg(c: Column) -> Column:
    """Average by a decimal sum, so that it does not depend on the order of rows."""
    return F.sum(c.cast("decimal(28,12)")).cast("double") / F.nullif(F.count(c), F.lit(0))


def drop_price_outliers(quotes: DataFrame, bound: float = 0.5) -> DataFrame:
    """Of batches with at least two prices, those further than ``bound`` from the upper median lose their price row."""
    prices = F.sort_array(F.collect_list(F.when(F.col("mark_price") > 0, F.col("mark_price"))).over(Window.partitionBy(*B)))
    with_median = quotes.withColumn("_p", prices).withColumn("_m", floor_index(F.col("_p"), 0.5))
    keep = (F.size("_p") < 2) | (F.abs(F.col("mark_price") - F.col("_m")) / F.col("_m") <= bound)
    return with_median.filter((F.col("mark_price") > 0) & keep).drop("_p", "_m")


def agg_snapshot(quotes: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Per (batch, symbol): total_oi, avg_funding, avg_mark after outlier removal, venues; 0 where nothing is left."""
    clean = drop_price_outliers(quotes).groupBy(*B).agg(exact_avg(F.col("mark_price")).alias("_mark"))
    sums = quotes.groupBy(*B).agg(
        F.sum(F.when(sane_oi(F.col("open_interest_usd")), F.col("open_interest_usd"))).alias("_oi"), exact_avg(F.when(sane_funding(F.col("funding_rate")), F.col("funding_rate"))).alias("_fr"), F.count(F.lit(1)).alias("venues")
    )
    joined = sums.join(clean, B, "left")
    if universe is not None:
        joined = universe.join(joined, B, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(*B, zero(F.col("_oi")).alias("total_oi"), zero(F.col("_fr")).alias("avg_funding"), zero(F.col("_mark")).alias("avg_mark"), F.coalesce("venues", F.lit(0)).cast("long").alias("venues"))


def with_oracle(snapshot: DataFrame, oracle: DataFrame) -> DataFrame:
    """reference_price: the oracle's, or the average where that is missing or 0; its source goes by the oracle row alone."""
    o = oracle.select(*B, F.col("price").alias("_o"), F.lit(True).alias("_there"))
    joined = snapshot.join(o, B, "left")
    return joined.select(*snapshot.columns, F.coalesce(F.nullif("_o", F.lit(0.0)), "avg_mark").alias("reference_price"), F.when(F.col("_there"), "oracle").otherwise("average").alias("price_source"))


def price_comparison(quotes: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Per (batch, symbol): spread in percent of the reference price, the signed deviation largest in size, venues by deviation."""
    kept = drop_price_outliers(quotes).join(snapshot.select(*B, "reference_price"), B)
    dev = kept.withColumn("dev", F.when(F.col("reference_price") > 0, (F.col("mark_price") - F.col("reference_price")) / F.col("reference_price") * 100.0))
    spread = (F.max("mark_price") - F.min("mark_price")) / F.nullif(F.max("reference_price"), F.lit(0.0)) * 100.0
    out = dev.groupBy(*B).agg(
        spread.alias("_s"),
        F.min(F.struct((-F.abs("dev")).alias("size"), "exchange", "dev")).alias("_top"),
        F.array_sort(F.collect_list(F.struct((-F.abs("dev")).alias("size"), "exchange"))).alias("_by"),
    )
    return out.select(
        *B,
        F.when((F.col("_s") > 50) | F.col("_s").isNull() | F.isnan("_s"), 0.0).otherwise(F.col("_s")).alias("spread_pct"),
        F.col("_top.dev").alias("max_deviation"),
        F.col("_top.exchange").alias("max_venue"),
        F.transform("_by", lambda x: x["exchange"]).alias("venues_by_deviation"),
    )


def venue_maps(quotes: DataFrame) -> DataFrame:
    """Per (batch, symbol) maps venue -> price, open interest, funding."""
    as_map = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("exchange", c)))))
    return quotes.groupBy(*B).agg(as_map("mark_price").alias("price_by_venue"), as_map("open_interest_usd").alias("oi_by_venue"), as_map("funding_rate").alias("funding_by_venue"))


def risk_signals(snapshot: DataFrame, comparison: DataFrame) -> DataFrame:
    """HIGH_FUNDING and PRICE_DEVIATION events with their severity."""
    joined = snapshot.join(comparison, B)
    f, d = F.abs("avg_funding"), F.abs("max_deviation")
    signal = lambda on, kind, severity, value: F.when(on, F.struct(F.lit(kind).alias("type"), severity.alias("severity"), value.alias("value")))
    funding = signal(f > 0.0005, "HIGH_FUNDING", F.when(f > 0.002, "critical").when(f > 0.001, "high").otherwise("medium"), F.col("avg_funding"))
    price = signal(d > 0.5, "PRICE_DEVIATION", F.when(d > 1.0, "high").otherwise("medium"), F.col("max_deviation"))
    return joined.select(*B, F.explode(F.filter(F.array(funding, price), lambda s: s.isNotNull())).alias("s")).select(*B, "s.type", "s.severity", "s.value")


def snapshot_long(quotes: DataFrame) -> DataFrame:
    """A row for every venue of the batch and every symbol of the batch; what is missing is 0."""
    grid = quotes.select("batch_ts", "symbol").distinct().join(quotes.select("batch_ts", "exchange").distinct(), "batch_ts")
    j = grid.join(quotes.select(*B, "exchange", "mark_price", "funding_rate", "open_interest_usd"), [*B, "exchange"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    price = zero("mark_price")
    return j.select(*B, "exchange", price.alias("mark_price"), price.alias("index_price"), zero("funding_rate").alias("funding_rate"), (zero("open_interest_usd") / F.when(price == 0, 1.0).otherwise(price)).alias("open_interest"), zero("open_interest_usd").alias("open_interest_usd"))


def snapshot_agg(quotes: DataFrame) -> DataFrame:
    """Per (batch, symbol): funding_spread (0 under two venues) and exchange_count, the venues of the whole batch."""
    venues = quotes.groupBy("batch_ts").agg(F.count_distinct("exchange").alias("exchange_count"))
    per = quotes.groupBy(*B).agg(F.when(F.count("funding_rate") >= 2, F.max("funding_rate") - F.min("funding_rate")).otherwise(0.0).alias("funding_spread"))
    return per.join(venues, "batch_ts")


def oi_share_by_venue(quotes: DataFrame, least: float = 0.5) -> DataFrame:
    share = F.col("open_interest_usd") / F.sum("open_interest_usd").over(Window.partitionBy(*B)) * 100.0
    return quotes.select(*B, "exchange", share.alias("share_pct")).filter(F.col("share_pct") >= least)


def latest_per_key(df: DataFrame, key: str, ts: str, *tie: str) -> DataFrame:
    """The row of each key that is greatest by (ts, tie...), with map-side combining."""
    rest = [c for c in df.columns if c != key]
    top = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, *tie)).alias("_r"))
    return top.select(key, "_r.*")
