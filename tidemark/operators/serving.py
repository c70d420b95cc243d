"""History, alert, tenant and dashboard queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import level_ordinal, score_level


def history(df: DataFrame, as_of: Column, hours: int = 24, ts: str = "time") -> DataFrame:
    """Rows of the last ``hours`` (clamped to 1..720) before ``as_of``."""
    hours = min(720, max(1, hours))
    return df.filter(F.unix_millis(ts) > F.unix_millis(as_of) - hours * 3_600_000)


def newest_per_symbol(df: DataFrame, n: int = 100, ts: str = "time") -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(ts)))).filter(F.col("_n") <= n).drop("_n")


def high_risk(scores: DataFrame, least: int = 60, n: int = 100) -> DataFrame:
    return scores.filter(F.col("risk_score") >= least).orderBy(F.desc("time"), "symbol").limit(n)


def with_level(scores: DataFrame) -> DataFrame:
    return scores.withColumn("level", score_level(F.col("risk_score")))


def alerts(scores: DataFrame) -> DataFrame:
    """Alert rows of the critical and high scores, the payload as JSON."""
    a = with_level(scores).filter(F.col("level").isin("critical", "high"))
    return a.select("symbol", "time", F.lit("CASCADE_RISK").alias("alert_type"), F.col("level").alias("severity"), F.format_string("%s risk %s (%d)", "symbol", "level", "risk_score").alias("message"), F.to_json(F.struct("risk_score", "level")).alias("data"))


def active_alerts(scores: DataFrame, least: int = 50) -> DataFrame:
    """Scores of the three upper levels, of their factors only those that score at least ``least``."""
    a = with_level(scores).filter(F.col("level").isin("critical", "high", "elevated"))
    return a.withColumn("factors", F.filter("factors", lambda f: f["score"] >= least))


def filter_by_plan(df: DataFrame, plans: DataFrame, plan: str) -> DataFrame:
    return df.join(plans.filter(F.col("plan") == plan).select("symbol"), "symbol", "left_semi")


def subscription_match(risks: DataFrame, subscriptions: DataFrame, event: str = "risk", keep: tuple[str, ...] = (), parts: int = 1) -> DataFrame:
    """(subscription_id, symbol, level, risk_score, and columns of ``risks`` to ``keep``) of enabled subscriptions to ``event``: no symbols means all, the level must reach the minimum.

    Equi joins alone: listed symbols are exploded and joined by symbol, subscriptions to all symbols join risks by minimum level. Symbols and levels
    are few, so with ``parts`` above 1 the risks are dealt to so many tasks, and the subscriptions go to each.
    """
    on = subscriptions.filter(F.col("enabled") & F.array_contains(F.split("events_csv", ","), event))
    rated = risks.withColumn("ord", level_ordinal(F.col("level"))).select("symbol", "level", "risk_score", "ord", *keep)
    share = []
    if parts > 1:
        share = ["_part"]
        rated = rated.withColumn("_part", F.pmod(F.xxhash64("symbol", "risk_score", *keep), F.lit(parts)).cast("int"))
        on = on.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = lambda df, *by: df.repartition(parts, *by) if share else df
    listed = on.filter("symbols_csv <> ''").select("subscription_id", "min_level_ord", F.explode(F.split("symbols_csv", ",")).alias("symbol"), *share)
    by_symbol = dealt(listed, "symbol", *share).join(dealt(rated, "symbol", *share), ["symbol", *share]).filter(F.col("ord") >= F.col("min_level_ord"))
    reached = rated.withColumn("min_level_ord", F.explode(F.sequence(F.lit(0), F.col("ord"))))
    open_ended = on.filter("symbols_csv = ''").select("subscription_id", F.col("min_level_ord").cast("int").alias("min_level_ord"), *share)
    every = dealt(open_ended, "min_level_ord", *share).join(dealt(reached, "min_level_ord", *share), ["min_level_ord", *share])
    names = ("subscription_id", "symbol", "level", "risk_score", *keep)
    return by_symbol.select(*names).unionByName(every.select(*names))


def audiences(subscriptions: DataFrame, event: str, size: int = 16_384) -> DataFrame:
    """(audience, symbols_csv, min_level_ord, subscription_ids): enabled subscriptions to ``event`` with equal wishes, in lists of about ``size`` at most.

    What matches one member of a list matches all, so a list can stand for its members.
    """
    on = subscriptions.filter(F.col("enabled") & F.array_contains(F.split("events_csv", ","), event))
    on = on.select(F.col("subscription_id").cast("long").alias("subscription_id"), "symbols_csv", F.col("min_level_ord").cast("int").alias("min_level_ord"))
    part = F.pmod(F.xxhash64("subscription_id"), F.lit(-(-on.count() // size) or 1)).alias("_part")
    lists = on.groupBy("symbols_csv", "min_level_ord", part).agg(F.collect_list("subscription_id").alias("subscription_ids"))
    return lists.select(F.concat_ws("|", "symbols_csv", "min_level_ord", "_part").alias("audience"), "symbols_csv", "min_level_ord", "subscription_ids")


def audience_match(risks: DataFrame, lists: DataFrame, keep: tuple[str, ...] = (), parts: int = 1) -> DataFrame:
    """(audience, symbol, level, risk_score, and ``keep``): ``subscription_match`` with lists of ``audiences`` in the place of subscriptions."""
    subs = lists.select(F.col("audience").alias("subscription_id"), F.lit(True).alias("enabled"), F.lit("any").alias("events_csv"), "symbols_csv", "min_level_ord")
    return subscription_match(risks, subs, "any", keep, parts).withColumnRenamed("subscription_id", "audience")


def audience_members(matched: DataFrame, lists: DataFrame, *keys: str, salts: int = 16, parts: int = 192) -> DataFrame:
    """``matched`` with a row for each member of its audience. ``keys`` tell the lists apart, ``salts`` shares deal one list's rows to as many tasks.

    A hash join by shuffle: as a broadcast, all copies of the lists would pass through the driver.
    """
    names = [c for c in matched.columns if c not in keys]
    on = [*keys, "_salt"]
    rows = matched.withColumn("_salt", F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int"))
    lists = lists.select(*keys, "subscription_ids", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    j = rows.repartition(parts, *on).join(lists.repartition(parts, *on).hint("shuffle_hash"), on)
    return j.select(F.explode("subscription_ids").alias("subscription_id"), *names)


def risk_payloads(risks: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscription_id, type, payload): to each subscription of 'risk' its matching risks as one JSON list, highest score first."""
    one = F.struct((-F.col("risk_score")).alias("at"), F.col("symbol"), F.col("risk_score").alias("riskScore"), F.col("level").alias("riskLevel"))
    lists = subscription_match(risks, subscriptions).groupBy("subscription_id").agg(F.array_sort(F.collect_list(one)).alias("r"))
    return lists.select("subscription_id", F.lit("risk").alias("type"), F.to_json(F.transform("r", lambda x: x.dropFields("at"))).alias("payload"))


def alert_payloads(risks: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscription_id, type, payload): to each subscription of 'alert' one JSON object with level, count and risks of the three upper levels."""
    one = F.struct((-F.col("risk_score")).alias("at"), F.col("symbol"), F.col("risk_score").alias("riskScore"), F.col("level").alias("riskLevel"))
    upper = subscription_match(risks, subscriptions, "alert").filter(F.col("level").isin("critical", "high", "elevated"))
    lists = upper.groupBy("subscription_id").agg(F.array_sort(F.collect_list(one)).alias("r"))
    body = F.struct(F.col("r")[0]["riskLevel"].alias("level"), F.size("r").alias("count"), F.transform("r", lambda x: x.dropFields("at")).alias("risks"))
    return lists.select("subscription_id", F.lit("alert").alias("type"), F.to_json(body).alias("payload"))


def data_payloads(symbols: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(subscription_id, type, payload): to each subscription of 'data' the symbols it asked for, or a null list for all of them."""
    on = subscriptions.filter(F.col("enabled") & F.array_contains(F.split("events_csv", ","), "data"))
    asked = on.filter("symbols_csv <> ''").select("subscription_id", F.explode(F.split("symbols_csv", ",")).alias("symbol"))
    found = asked.join(symbols.select("symbol").distinct(), "symbol").groupBy("subscription_id").agg(F.array_sort(F.collect_list("symbol")).alias("symbols"))
    j = on.select("subscription_id", (F.col("symbols_csv") == "").alias("all")).join(found, "subscription_id", "left")
    kept = F.when(~F.col("all"), F.coalesce("symbols", F.array().cast("array<string>")))
    return j.select("subscription_id", F.lit("data").alias("type"), F.to_json(F.struct(kept.alias("symbols"))).alias("payload"))


def risk_summary(latest: DataFrame) -> DataFrame:
    """Highest row (first symbol on ties) and counts per level."""
    x = with_level(latest)
    return x.agg(
        F.max(F.col("risk_score")).cast("long").alias("top_score"),
        F.min_by("symbol", F.struct(-F.col("risk_score"), "symbol")).alias("top_symbol"),
        *[F.count_if(F.col("level") == v).alias(f"n_{v}") for v in ("low", "moderate", "elevated", "high", "critical")],
    )


def priority_sort(latest: DataFrame, first: list[str]) -> DataFrame:
    """place: listed symbols in their order, the rest by score.

    A row's place is its rank among its equals plus the rows of the groups before; there are at most 101 scores for each listed
    symbol and the rest, so the table of groups is small.
    """
    at = F.array_position(F.array(*map(F.lit, first)), F.col("symbol"))
    x = latest.withColumn("_at", F.when(at > 0, at).otherwise(len(first) + 1)).withColumn("_s", -F.col("risk_score"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_at", "_s").rowsBetween(Window.unboundedPreceding, -1))
    groups = x.groupBy("_at", "_s").agg(F.count(F.lit(1)).alias("n")).select("_at", "_s", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_at", "_s").orderBy("symbol"))
    return x.withColumn("_rank", rank).join(groups, ["_at", "_s"]).select(*latest.columns, (F.col("_before") + F.col("_rank")).cast("long").alias("place"))
