"""Stress score per symbol from rolling statistics of the price deviation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import interpolate_score, prediction, risk_level, round_clamp_score, sigmoid, vol_multiplier
from tidemark.operators.scans import with_positions
from tidemark.operators.windows import prefix_stats, rolling_order_stats


def stress_score(series: DataFrame, value: str = "deviation", history: int = 43_200, warm: int = 1440, lookback: int = 4320, z_scale: float = 20.0, chunk: int | None = None) -> DataFrame:
    """Adds z, regime, level, score, confidence, percentile rank.

    Windows include the current row. Mean and deviation come from prefix sums; the order statistics of value and z
    from one pass of halo chunks each.
    """
    x = with_positions(series.select("symbol", "ts", F.coalesce(F.col(value), F.lit(0.0)).alias("x")), name="_p").withColumn("rn", F.col("_p") + 1)
    s = prefix_stats(x, "x", history, position="_p")
    z = F.when(F.col("w_std_pop") > 0, (F.col("x") - F.col("w_mean")) / F.when(F.col("w_std_pop") > 0, F.col("w_std_pop"))).otherwise(0.0)
    s = s.select("symbol", "ts", "x", "_p", "rn", F.when(F.col("rn") > 1, z).alias("zb"))
    v = prefix_stats(s, "zb", lookback, prefix="v", position="_p").select("symbol", "ts", "x", "_p", "rn", "zb", F.coalesce("v_std_pop", F.lit(0.0)).alias("vol_of_stress"))
    q = rolling_order_stats(v, "x", history, (0.9, 0.95, 0.99), chunk, rank=True, position="_p")
    q = rolling_order_stats(q, "zb", history, (0.33, 0.67), chunk, position="_p")
    return scored_rows(q, history, warm, z_scale)


def scored_rows(q: DataFrame, history: int, warm: int, z_scale: float) -> DataFrame:
    """The score of rows that have their rolling statistics (x, rn, zb, vol_of_stress, quantiles and rank)."""
    nz = F.least(F.col("rn") - 1, F.lit(history))
    regime = F.when(nz < 60, "MEDIUM").when(F.col("vol_of_stress") < F.col("zb_q33"), "LOW").when(F.col("vol_of_stress") > F.col("zb_q67"), "HIGH").otherwise("MEDIUM")
    is_warm = F.col("rn") >= warm
    t = q.withColumn("z", F.coalesce("zb", F.lit(0.0))).withColumn("regime", regime).withColumn("warm", is_warm)
    t = t.withColumn("raw_score", F.when(F.col("warm"), F.col("z") * z_scale).otherwise(interpolate_score(F.col("x"))))
    m = vol_multiplier(F.col("regime"))
    at = lambda name, cold: F.when(F.col("warm"), F.col(name) * m).otherwise(F.lit(cold))
    level = risk_level(F.col("x"), at("x_q90", 0.15), at("x_q95", 0.30), at("x_q99", 0.60), F.col("raw_score"))
    out = t.withColumn("level", level).withColumn("score", round_clamp_score(F.col("raw_score")))
    return out.select("symbol", "ts", "x", "z", "regime", "warm", "vol_of_stress", "level", "score", sigmoid(-7.0 + 0.1 * F.col("score")).alias("confidence"), F.col("x_rank").alias("pct_rank"), F.when(F.col("warm"), F.col("x_q99") * m).otherwise(0.60).alias("critical_at"))


def with_factors(scored: DataFrame) -> DataFrame:
    """Adds the three described factors of a score."""
    factor = lambda name, score, weight, value, at, text: F.struct(F.lit(name).alias("name"), score.alias("score"), F.lit(weight).alias("weight"), value.alias("value"), at.alias("threshold"), text.alias("description"))
    zero = F.lit(0)
    return scored.withColumn(
        "factors",
        F.array(
            factor("Price Stress", F.col("score"), 1.0, F.col("z"), F.col("critical_at"), F.format_string("z=%.2f, pctile=%.1f, spread=%.4f%%", "z", "pct_rank", "x")),
            factor("Volatility Regime", zero, 0.0, F.col("vol_of_stress"), F.lit(0.0), F.format_string("Regime: %s, vol-of-stress=%.4f", "regime", "vol_of_stress")),
            factor("Dynamic Threshold", zero, 0.0, F.col("critical_at"), F.lit(0.0), F.format_string("critical=%.4f", "critical_at")),
        ),
    )


def with_prediction(scored: DataFrame, funding: str = "avg_funding", oi: str = "total_oi", base: str = "reference_price", least: int = 40) -> DataFrame:
    """Adds the nullable prediction struct of rows that score at least ``least``."""
    p = prediction(F.col("score"), F.col("z"), F.col(funding), F.col(oi), F.col(base), F.col("confidence"))
    return scored.withColumn("prediction", F.when(F.col("score") >= least, p))


def liquidity_factor(series: DataFrame, rows: int = 43_200, least: int = 60, chunk: int | None = None) -> DataFrame:
    """factor sqrt(oi / rolling median oi), 1 with fewer than ``least`` values."""
    placed = with_positions(series.select("symbol", "ts", F.col("open_interest_usd").alias("oi")), name="_p")
    n = F.col("_p") + 1
    q = rolling_order_stats(placed, "oi", rows, (0.5,), chunk, position="_p")
    ok = (F.col("n") >= least) & (F.col("oi_q50") > 0) & (F.col("oi") > 0)
    return q.withColumn("n", n).withColumn("factor", F.when(ok, F.sqrt(F.col("oi") / F.when(F.col("oi_q50") > 0, F.col("oi_q50")))).otherwise(1.0)).drop("n", "_p")
