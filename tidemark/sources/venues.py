"""Raw venue payloads to canonical quotes (bronze to silver).

Landed pages are rows (venue, endpoint, symbol, payload JSON, ts): the response of one endpoint to one fetch. ``fields_of_pages``
reads each venue's own shapes and brings the endpoints of a fetch together; pages that list many instruments are exploded and
matched with a table of listings. ``normalize_venue_quotes`` takes fields that are already flat in one payload. Rules that must hold for each venue are expressions over the parsed
payload; a quote with one bad field or a failed price guard is rejected whole, as the batch path has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAYLOAD = (
    "open_interest string, value string, mark string, index string, last string, funding string, predicted string, funding_time string, multiplier string,"
    " oracle string, long_oi string, short_oi string, borrow_long string, borrow_short string, token string"
)
NAMES = [f.split()[0] for f in PAYLOAD.split(", ")]
#: Where each venue's endpoints for one instrument have their fields.
PATHS = {
    "binance": {"premiumIndex": {"mark": "$.markPrice", "index": "$.indexPrice", "funding": "$.lastFundingRate", "funding_time": "$.nextFundingTime"}, "openInterest": {"open_interest": "$.openInterest"}},
    "bybit": {
        "tickers": {"mark": "$.result.list[0].markPrice", "index": "$.result.list[0].indexPrice", "last": "$.result.list[0].lastPrice", "funding": "$.result.list[0].fundingRate", "funding_time": "$.result.list[0].nextFundingTime"},
        "open-interest": {"open_interest": "$.result.list[0].openInterest"},
    },
    "okx": {"open-interest": {"open_interest": "$.data[0].oi"}, "funding-rate": {"funding": "$.data[0].fundingRate", "funding_time": "$.data[0].nextFundingTime"}, "mark-price": {"mark": "$.data[0].markPx"}, "index-tickers": {"index": "$.data[0].idxPx"}},
    "bitget": {"open-interest": {"open_interest": "$.data.amount"}, "current-fundRate": {"funding": "$.data.fundingRate"}, "mark-price": {"mark": "$.data.markPrice"}},
    "gateio": {
        "contract": {"open_interest": "$.position_size", "multiplier": "$.quanto_multiplier", "last": "$.last_price", "funding": "$.funding_rate", "funding_time": "$.funding_next_apply", "mark": "$.mark_price", "index": "$.index_price"}
    },
    "mexc": {"open_interest": {"value": "$.data.value"}, "funding_rate": {"funding": "$.data.fundingRate", "funding_time": "$.data.nextSettleTime"}, "index_price": {"index": "$.data.indexPrice"}},
    "kucoin": {"openInterest": {"open_interest": "$.data.openInterest"}, "funding-rate": {"funding": "$.data.value", "funding_time": "$.data.timePoint"}, "mark-price": {"mark": "$.data.value", "index": "$.data.indexPrice"}},
}
#: Hours until the next funding, where a venue does not say.
FUNDING_HOURS = {"bitget": 8, "kraken": 4, "dydx": 1, "hyperliquid": 1, "gmx": 8}
#: Venues whose quotes must have mark and index within 10 % of each other.
GUARDED = ("binance", "bybit", "okx", "gateio", "kucoin", "kraken", "hyperliquid")


def _n(name: str) -> Column:
    return F.expr(f"try_cast(p.{name} as double)")


def _kraken_rate(name: str) -> Column:
    """Four-hour rate to eight hours; rates over 1 % are percentages."""
    r = _n(name)
    return F.when(F.abs(r) > 0.01, r / 100.0).otherwise(r) * 2.0


def _listed(rows: Column, **fields: str) -> Column:
    """An array of (listed, the numbers of NAMES) from ``rows``, the array of a page that lists many instruments; ``fields``: where each is."""

    def at(r: Column, path: str) -> Column:
        for step in path.split("."):
            r = r[step]
        return r

    return F.transform(rows, lambda r: F.struct(at(r, fields["listed"]).alias("listed"), *[(at(r, fields[n]).try_cast("double") if n in fields else F.lit(None).cast("double")).alias(n) for n in NAMES]))


def fields_of_pages(pages: DataFrame, listings: DataFrame, sound: Column | None = None) -> DataFrame:
    """(venue, symbol, ts, p) with the fields of PAYLOAD as numbers (null where a text is none), all endpoints of a fetch together.

    Texts become numbers before pages are brought together: what a stream holds of a fetch is then of fixed size, and no text is parsed twice.
    Of a page that landed twice with different numbers the greater one counts.
    ``listings`` (venue, listed, symbol) names the instruments of venues whose pages list many of them. Only ``sound`` pages count, a condition
    tested after the venue, as it may parse the payload.
    """
    paths = [(v, e, n, path) for v, by in PATHS.items() for e, found in by.items() for n, path in found.items()]

    def field(name: str) -> Column:
        out = F.lit(None).cast("string")
        for v, e, n, path in paths:
            if n == name:
                out = F.when((F.col("venue") == v) & (F.col("endpoint") == e), F.get_json_object("payload", path)).otherwise(out)
        return out.try_cast("double").alias(name)

    sound = F.lit(True) if sound is None else sound
    single = pages.filter(F.col("venue").isin(*PATHS)).filter(sound).select("venue", "symbol", "ts", *[field(n) for n in NAMES])
    kraken = F.from_json(F.get_json_object("payload", "$.tickers"), "array<struct<symbol:string,openInterest:string,markPrice:string,indexPrice:string,fundingRate:string,fundingRatePrediction:string>>")
    dydx = F.map_entries(F.from_json(F.get_json_object("payload", "$.markets"), "map<string,struct<openInterest:string,oraclePrice:string,nextFundingRate:string>>"))
    universe = F.from_json(F.get_json_object("payload", "$[0].universe"), "array<struct<name:string>>")
    contexts = F.from_json(F.get_json_object("payload", "$[1]"), "array<struct<funding:string,openInterest:string,oraclePx:string,markPx:string>>")
    markets = F.from_json(
        F.get_json_object("payload", "$.markets"),
        "array<struct<marketToken:string,longInterestUsd:string,shortInterestUsd:string,indexTokenPrice:struct<max:string>,borrowingFactorPerSecondForLongs:string,borrowingFactorPerSecondForShorts:string>>",
    )
    prices = F.map_entries(F.from_json("payload", "map<string,struct<maxPrice:string>>"))
    shapes = {
        ("kraken", "tickers"): _listed(kraken, listed="symbol", open_interest="openInterest", mark="markPrice", index="indexPrice", funding="fundingRate", predicted="fundingRatePrediction"),
        ("dydx", "perpetualMarkets"): _listed(dydx, listed="key", open_interest="value.openInterest", oracle="value.oraclePrice", funding="value.nextFundingRate"),
        ("hyperliquid", "metaAndAssetCtxs"): _listed(F.arrays_zip(universe.alias("u"), contexts.alias("c")), listed="u.name", open_interest="c.openInterest", mark="c.markPx", oracle="c.oraclePx", funding="c.funding"),
        ("gmx", "markets"): _listed(markets, listed="marketToken", long_oi="longInterestUsd", short_oi="shortInterestUsd", token="indexTokenPrice.max", borrow_long="borrowingFactorPerSecondForLongs", borrow_short="borrowingFactorPerSecondForShorts"),
        ("gmx", "tickers"): _listed(prices, listed="key", mark="value.maxPrice"),
    }
    rows = None
    for (v, e), made in shapes.items():
        own = (F.col("venue") == v) & (F.col("endpoint") == e)
        rows = F.when(own, made) if rows is None else rows.when(own, made)
    many = pages.filter(F.col("venue").isin(*sorted({v for v, _ in shapes}))).filter(sound).select("venue", "ts", F.explode(rows).alias("r")).select("venue", "ts", "r.*")
    every = single.unionByName(many.join(listings, ["venue", "listed"]).drop("listed"))
    merged = every.groupBy("venue", "symbol", "ts").agg(*[F.max(n).alias(n) for n in NAMES])
    return merged.select("venue", "symbol", "ts", F.struct(*NAMES).alias("p"))


def normalize_venue_pages(pages: DataFrame, listings: DataFrame, guard: float = 0.10, sound: Column | None = None) -> DataFrame:
    """Canonical quotes from landed pages, the ``sound`` ones if that is given."""
    return _normalized(fields_of_pages(pages, listings, sound), guard)


def normalize_venue_quotes(raw: DataFrame, guard: float = 0.10) -> DataFrame:
    """exchange, symbol, open_interest, open_interest_usd, funding_rate, funding_time, mark_price, index_price, ts."""
    return _normalized(raw.select("venue", "symbol", "ts", F.from_json("payload", PAYLOAD).alias("p")), guard)


def _normalized(fields: DataFrame, guard: float) -> DataFrame:
    x = fields.withColumnRenamed("venue", "exchange")
    venue = F.col("exchange")
    at = lambda default, **by: _case(venue, default, by)
    gmx_usd, gmx_price, gmx_token = (_n("long_oi") + _n("short_oi")) / 1e30, _n("mark") / 1e30, F.coalesce(_n("token"), _n("mark")) / 1e30
    kraken, predicted = _kraken_rate("funding"), _kraken_rate("predicted")
    better = predicted.isNotNull() & ~F.isnan(predicted) & (predicted != 0) & (F.abs(predicted) < F.abs(kraken))
    hours = at(F.lit(0), **{v: F.lit(h) for v, h in FUNDING_HOURS.items()})
    next_funding = F.timestamp_millis(F.unix_millis("ts") + hours * 3_600_000)
    mark = at(_n("mark"), mexc=_n("index"), dydx=_n("oracle"), gmx=gmx_price)
    out = x.select(
        "exchange",
        "symbol",
        "ts",
        mark.alias("mark_price"),
        at(F.coalesce(_n("index"), _n("mark")), bitget=_n("mark"), mexc=_n("index"), dydx=_n("oracle"), hyperliquid=_n("oracle"), gmx=gmx_price).alias("index_price"),
        at(_n("funding"), kraken=F.when(better, predicted).otherwise(kraken), hyperliquid=_n("funding") * 8.0, gmx=(_n("borrow_long") + _n("borrow_short")) / 2.0 * 8.0 * 3600.0).alias("funding_rate"),
        F.coalesce(F.timestamp_millis(at(_n("funding_time"), gateio=_n("funding_time") * 1000.0).cast("long")), next_funding).alias("funding_time"),
        at(_n("open_interest"), gateio=_n("open_interest") * _n("multiplier"), mexc=F.when(_n("index") > 0, _n("value") / F.when(_n("index") > 0, _n("index"))).otherwise(0.0), gmx=F.when(gmx_token > 0, gmx_usd / F.when(gmx_token > 0, gmx_token)).otherwise(0.0)).alias("open_interest"),
        at(
            _n("open_interest") * _n("mark"),
            bybit=_n("open_interest") * _n("last"),
            gateio=_n("open_interest") * _n("multiplier") * _n("last"),
            mexc=_n("value"),
            dydx=_n("open_interest") * _n("oracle"),
            gmx=gmx_usd,
        ).alias("open_interest_usd"),
    )
    sound = F.lit(True)
    for c in ("mark_price", "index_price", "open_interest", "open_interest_usd"):
        sound = sound & F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf"))
    sound = sound & F.col("funding_rate").isNotNull() & ~F.isnan("funding_rate") & (F.abs("funding_rate") < float("inf"))
    both = (F.col("mark_price") > 0) & (F.col("index_price") > 0)
    near = ~venue.isin(*GUARDED) | ~both | (F.abs(F.col("mark_price") - F.col("index_price")) / F.col("index_price") <= guard)
    return out.filter(sound & near)


def _case(venue: Column, default: Column, by: dict[str, Column]) -> Column:
    out = None
    for name, c in by.items():
        out = F.when(venue == name, c) if out is None else out.when(venue == name, c)
    return default if out is None else out.otherwise(default)


ORACLE = "parsed array<struct<id:string,price:struct<price:string,conf:string,expo:int,publish_time:long>,ema_price:struct<price:string,expo:int>>>"


def normalize_oracle_price(raw: DataFrame, feeds: DataFrame) -> DataFrame:
    """symbol, price, confidence, ema_price, publish_time from ``payload`` JSON; mantissa x 10^expo."""
    x = raw.select(F.explode(F.from_json("payload", ORACLE)["parsed"]).alias("f"))
    scale = F.pow(F.lit(10.0), F.col("f.price.expo"))
    num = lambda c: F.expr(f"try_cast({c} as double)")
    ema = F.coalesce(num("f.ema_price.price"), num("f.price.price"))
    out = x.select(F.col("f.id").alias("feed_id"), (num("f.price.price") * scale).alias("price"), (num("f.price.conf") * scale).alias("confidence"), (ema * scale).alias("ema_price"), F.timestamp_seconds("f.price.publish_time").alias("publish_time"))
    return out.join(feeds, "feed_id").drop("feed_id")


def parse_klines(pages: DataFrame) -> DataFrame:
    """symbol, ts, mark_price, rejected (the close as it was, where it is no finite number) of every row of kline pages."""
    rows = pages.select("symbol", F.explode(F.from_json("payload", "array<array<string>>")).alias("k"))
    close = F.expr("try_cast(k[4] as double)")
    sound = close.isNotNull() & ~F.isnan(close) & (F.abs(close) < float("inf"))
    out = rows.select("symbol", F.timestamp_millis(F.expr("try_cast(k[0] as bigint)")).alias("ts"), F.when(sound, close).alias("mark_price"), F.when(~sound, F.coalesce(F.col("k")[4], F.lit("null"))).alias("rejected"))
    return out.filter(F.col("ts").isNotNull())


def load_klines(pages: DataFrame) -> DataFrame:
    """symbol, ts, mark_price: element 0 of a kline is the open time, element 4 the close. Bad closes go to ``rejected_klines``."""
    return parse_klines(pages).filter("rejected is null").drop("rejected")


def rejected_klines(pages: DataFrame) -> DataFrame:
    """symbol, ts and the close as it came, of the rows that load_klines leaves out."""
    return parse_klines(pages).filter("rejected is not null").drop("mark_price")


def load_funding_history(pages: DataFrame) -> DataFrame:
    rows = pages.select("symbol", F.explode(F.from_json("payload", "array<struct<fundingTime:bigint,fundingRate:string>>")).alias("k"))
    return rows.select("symbol", F.timestamp_millis("k.fundingTime").alias("funding_time"), F.expr("try_cast(k.fundingRate as double)").alias("funding_rate")).filter("funding_rate is not null")


def load_oi_history(pages: DataFrame) -> DataFrame:
    rows = pages.select("symbol", F.explode(F.from_json("payload", "array<struct<timestamp:bigint,sumOpenInterestValue:string>>")).alias("k"))
    return rows.select("symbol", F.timestamp_millis("k.timestamp").alias("ts"), F.expr("try_cast(k.sumOpenInterestValue as double)").alias("open_interest_usd")).filter("open_interest_usd is not null")
