"""Scalar functions as Column expressions; thresholds default to the fixed values of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of risk levels, sector add-ons, news words by category in order of precedence.
LEVELS = ("low", "moderate", "elevated", "high", "critical")
SECTOR_RISK = {"Tech": 10, "Auto": 15, "Finance": 5, "Energy": 12, "Healthcare": 3}
NEWS_WORDS = {
    "crypto": ("bitcoin", "btc", "ethereum", "eth", "solana", "crypto"),
    "blockchain": ("blockchain", "defi", "nft", "web3"),
    "markets": ("fed", "market", "stock", "regulation"),
}


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def round_clamp_score(x: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), round_half_up(x))).cast("int")


def safe_divide(a: Column, b: Column) -> Column:
    """0 where the divisor is not positive."""
    return F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)


def interpolate_score(v: Column, elevated: float = 0.15, high: float = 0.30, critical: float = 0.60) -> Column:
    """Piecewise linear through (0, 0), (elevated, 40), (high, 60), (critical, 80), then 20 a multiple up to 100."""
    return (
        F.when(v <= 0, 0.0)
        .when(v < elevated, v / elevated * 40.0)
        .when(v < high, 40.0 + (v - elevated) / (high - elevated) * 20.0)
        .when(v < critical, 60.0 + (v - high) / (critical - high) * 20.0)
        .otherwise(F.least(F.lit(100.0), 80.0 + (v / critical - 1.0) * 20.0))
    )


def risk_level(raw: Column, elevated: Column, high: Column, critical: Column, score: Column) -> Column:
    return F.when(raw >= critical, "critical").when(raw >= high, "high").when(raw >= elevated, "elevated").when(score >= 20, "moderate").otherwise("low")


def score_level(score: Column) -> Column:
    """Level from a score alone, by bands of 20."""
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 40, "elevated").when(score >= 20, "moderate").otherwise("low")


def level_ordinal(level: Column) -> Column:
    """Place of a level in LEVELS from 0, -1 for other strings."""
    return F.array_position(F.array(*map(F.lit, LEVELS)), level).cast("int") - 1


def vol_multiplier(regime: Column) -> Column:
    return F.when(regime == "LOW", 0.75).when(regime == "HIGH", 1.5).otherwise(1.0)


def funding_regime(rate: Column, bound: float = 0.0001) -> Column:
    return F.when(rate > bound, 1).when(rate < -bound, -1).otherwise(0)


def prediction(score: Column, z: Column, funding: Column, total_oi: Column, base: Column, probability: Column) -> Column:
    """Struct of direction, probability, estimated_impact, time_window, trigger_price, trigger_distance."""
    severity = score / 100.0
    distance = F.greatest(F.lit(2.0), 6.0 - severity * 4.0)
    priced = F.coalesce(base, F.lit(0.0)) > 0
    direction = F.when(funding > 0, "long_squeeze").otherwise("short_squeeze")
    shift = F.when(funding > 0, 1.0 - distance / 100.0).otherwise(1.0 + distance / 100.0)
    window = F.when(priced & (F.abs(z) >= 3), "1-4 hours").when(priced & (F.abs(z) >= 2), "4-12 hours").otherwise("12-24 hours")
    return F.struct(
        direction.alias("direction"),
        F.least(F.lit(0.95), F.greatest(F.lit(0.05), probability)).alias("probability"),
        F.when(priced, F.greatest(F.lit(0.0), F.coalesce(total_oi, F.lit(0.0))) * (0.03 + severity * 0.07)).otherwise(0.0).alias("estimated_impact"),
        window.alias("time_window"),
        F.when(priced, base * shift).otherwise(0.0).alias("trigger_price"),
        distance.alias("trigger_distance"),
    )


def calibrated_interval(score: Column, intercept: Column, slope: Column, var_a: Column, cov: Column, var_b: Column, z_alpha: float = 1.96) -> Column:
    """Struct of probability, lower, upper; without covariance the interval is a point."""
    z = intercept + slope * score
    se = F.coalesce(F.sqrt(F.greatest(F.lit(0.0), var_a + 2 * cov * score + var_b * score * score)), F.lit(0.0))
    return F.struct(sigmoid(z).alias("probability"), sigmoid(z - z_alpha * se).alias("lower"), sigmoid(z + z_alpha * se).alias("upper"))


def wilson_interval(positives: Column, total: Column, z_alpha: float = 1.96) -> Column:
    """Struct of lower, upper, point; (0, 1, 0) without observations."""
    z2 = z_alpha * z_alpha
    n = F.when(total > 0, total)
    center = (positives + z2 / 2) / (n + z2)
    margin = z_alpha * F.sqrt(positives * (n - positives) / n + z2 / 4) / (n + z2)
    return F.struct(
        F.coalesce(F.greatest(F.lit(0.0), center - margin), F.lit(0.0)).alias("lower"), F.coalesce(F.least(F.lit(1.0), center + margin), F.lit(1.0)).alias("upper"), F.coalesce(positives / n, F.lit(0.0)).alias("point")
    )


def minute_bucket(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def five_min_bucket(ts: Column) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / 300) * 300)


def stock_change(price: Column, *closes: Column) -> Column:
    """Struct of previous_close, change, change_pct; the first close that is not null or 0 counts, else the price."""
    previous = F.coalesce(*[F.nullif(c, F.lit(0.0)) for c in closes], price)
    return F.struct(
        previous.alias("previous_close"),
        F.when(previous > 0, price - previous).otherwise(0.0).alias("change"),
        F.when(previous > 0, (price - previous) / F.when(previous > 0, previous) * 100.0).otherwise(0.0).alias("change_pct"),
    )


def stock_risk(price: Column, change_pct: Column, sector: Column, volatility: Column | None = None, extra: Column | None = None) -> Column:
    """Struct of volatility, risk_score, risk_level, direction, probability, target_price (the last three null under 40).

    ``extra`` are points from volume, at most 20 (0 by default).
    """
    move = F.abs(change_pct)
    vol = F.coalesce(F.nullif(volatility, F.lit(0.0)), move * 2) if volatility is not None else move * 2
    add_on = F.lit(5)
    for name, points in SECTOR_RISK.items():
        add_on = F.when(sector == name, points).otherwise(add_on)
    points = F.when(vol > 5, 40).when(vol > 3, 30).when(vol > 2, 20).when(vol > 1, 10).otherwise(0) + F.when(move > 5, 30).when(move > 3, 20).when(move > 1.5, 10).otherwise(0) + add_on
    if extra is not None:
        points = points + F.least(F.lit(20.0), extra)
    score = F.least(F.lit(100), round_half_up(points.cast("double"))).cast("int")
    up = change_pct > 0
    return F.struct(
        vol.alias("volatility"),
        score.alias("risk_score"),
        score_level(score).alias("risk_level"),
        F.when(score >= 40, F.when(up, "bullish").otherwise("bearish")).alias("direction"),
        F.when(score >= 40, 0.5 + score / 200.0).alias("probability"),
        F.when(score >= 40, round_half_up(price * F.when(up, 1.02).otherwise(0.98) * 100.0) / 100.0).alias("target_price"),
    )


def news_category(title: Column) -> Column:
    """First category one of whose words the lower-cased title holds, else tech."""
    lower, out = F.lower(title), None
    for name, words in NEWS_WORDS.items():
        hit = lower.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("tech")


def signed_percent(x: Column) -> Column:
    return F.format_string("%+.4f%%", x)
