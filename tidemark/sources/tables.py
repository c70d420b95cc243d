"""Table maintenance without primary keys: idempotent append, upsert, inventory, migration, report sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return batch.withColumn("_n", n).filter("_n = 1").drop("_n")


def rows_to_append(target: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of a batch whose key the target lacks, the first of each key."""
    return keep_first(batch, keys, order).join(target.select(*keys), keys, "left_anti").select(*batch.columns)


def append_idempotent(batch: DataFrame, path: str, keys: list[str], order: str) -> int:
    """Append the new rows to a Parquet table and return how many they are; a second run adds nothing."""
    spark = batch.sparkSession
    try:
        target = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        target = batch.limit(0)
    from pyspark.sql import Observation

    seen = Observation("appended")
    rows_to_append(target, batch, keys, order).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def upsert_latest(target: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Target and batch with the last row of each key; batch rows rank by ``order``, after every target row."""
    both = target.withColumn("_b", F.lit(0)).unionByName(batch.withColumn("_b", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_b"), F.desc(order)))
    return both.withColumn("_n", n).filter("_n = 1").drop("_n", "_b")


def table_inventory(**tables: DataFrame) -> DataFrame:
    """table_name and rows of each table, in one union of aggregates."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def migrate_risk_table(legacy: DataFrame) -> DataFrame:
    """Legacy risk rows to the current schema: null and NaN become 0, the confidence is recomputed from the score."""
    score = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0))
    return legacy.select("time", "symbol", score.cast("int").alias("risk_score"), F.coalesce("level", F.lit("low")).alias("risk_level"), (1.0 / (1.0 + F.exp(-0.1 * (score - 50.0)))).alias("confidence"))


def _or_zero(name: str) -> Column:
    """Null and NaN become 0."""
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(name)


def _or_null(name: str) -> Column:
    return F.nullif(F.col(name), F.lit("")).alias(name)


def migrate_market_snapshots(legacy: DataFrame) -> DataFrame:
    """Legacy venue rows (open_interest_value) to the current ones (open_interest_usd)."""
    names = ("mark_price", "index_price", "funding_rate", "open_interest")
    return legacy.select("time", "symbol", "exchange", *[_or_zero(n) for n in names], _or_zero("open_interest_value").alias("open_interest_usd"))


def migrate_aggregated_metrics(legacy: DataFrame) -> DataFrame:
    """Legacy aggregates to snapshots; the old schema has no funding spread."""
    renamed = (("avg_mark_price", "avg_mark_price"), ("avg_funding_rate", "avg_funding_rate"), ("total_oi_value", "total_oi_usd"), ("price_deviation", "price_spread_pct"))
    return legacy.select("time", "symbol", *[_or_zero(a).alias(b) for a, b in renamed], F.lit(0.0).alias("funding_spread_pct"), F.coalesce("exchanges_count", F.lit(0)).cast("int").alias("exchange_count"))


def migrate_alerts(legacy: DataFrame) -> DataFrame:
    """Legacy alerts; empty messages and data become null."""
    return legacy.select("time", "symbol", "alert_type", "severity", _or_null("message"), _or_null("data"))


def upsert_partitions(batch: DataFrame, path: str, keys: list[str], order: str, partition: str) -> None:
    """Upsert into a Parquet table partitioned by ``partition``: only the partitions that the batch touches are written anew.

    ``partition`` must be one of the keys: a key that moved to another partition would leave its old row where nothing looks for it.
    """
    if partition not in keys:
        raise ValueError(f"{partition} must be one of the keys")
    spark = batch.sparkSession
    try:
        target = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        target = batch.limit(0)
    touched = target.join(batch.select(partition).distinct(), partition, "left_semi").select(*batch.columns)
    merged = upsert_latest(touched, batch, keys, order)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """JSON lines, a file a partition."""
    report.write.mode("overwrite").json(path)
