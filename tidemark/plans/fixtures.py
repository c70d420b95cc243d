"""Market tables derived from the base tables by views that run unchanged in Spark SQL and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("events", "customer", "part", "documents")

VIEWS: dict[str, str] = {
    "ticks": """select event_id, event_type as symbol, concat('ex', cast(user_id % 11 as varchar(10))) as exchange, ts,
       100.0 + value / 20.0 as mark_price, 100.0 + (value + user_id % 5) / 20.0 as index_price,
       (value - 20.0) / 10000.0 as funding_rate, value * 100000.0 as open_interest_usd from events""",
    "mark_prices": "select symbol, date_trunc('minute', ts) as ts, max_by(mark_price, event_id) as mark_price from ticks group by 1, 2",
    "liquidations": """select concat(event_type, ':', case when user_id % 3 = 0 then 'BUY' else 'SELL' end, ':', cast(event_id as varchar(20))) as id,
       event_type as symbol, case when user_id % 3 = 0 then 'BUY' else 'SELL' end as side,
       100.0 + value / 20.0 as price, cast(1 + user_id % 7 as double) as quantity,
       (100.0 + value / 20.0) * cast(1 + user_id % 7 as double) as usd_value, ts from events""",
    "funding_rates": "select symbol, date_trunc('day', ts) as funding_time, avg(funding_rate) as funding_rate from ticks group by 1, 2",
    "open_interest": "select symbol, date_trunc('hour', ts) as ts, sum(open_interest_usd) as open_interest_usd from ticks group by 1, 2",
    "quotes": """select batch_ts, symbol, exchange, max_by(mark_price, event_id) as mark_price, max_by(index_price, event_id) as index_price,
       max_by(funding_rate, event_id) as funding_rate, max_by(open_interest_usd, event_id) as open_interest_usd, max(ts) as quote_ts
       from (select *, date_trunc('day', ts) as batch_ts from ticks) t group by 1, 2, 3""",
    "oracle_prices": "select batch_ts, symbol, avg(index_price) as price, stddev(index_price) as confidence from quotes where symbol <> 'view' group by 1, 2",
    "risk_scores": """select symbol, ts as time, cast(least(100, greatest(0, floor((mark_price - 100.0) * 20.0 + 0.5))) as int) as risk_score,
       1.0 / (1.0 + exp(-(-7.0 + 0.1 * least(100.0, greatest(0.0, floor((mark_price - 100.0) * 20.0 + 0.5)))))) as confidence from mark_prices""",
    "cascade_events": """select concat(event_type, ':LONG_SQUEEZE:', cast(event_id as varchar(20))) as id, event_type as symbol, 'LONG_SQUEEZE' as direction,
       ts as start_time, ts + interval '5' minute as end_time, -value / 20.0 as price_change_pct, value * 1000.0 as liquidation_volume_usd
       from events where value > 60""",
    "plans": """select 'starter' as plan, 'click' as symbol, 60 as rate_limit union all select 'growth', 'click', 300 union all select 'growth', 'view', 300
       union all select 'enterprise', 'click', 1000 union all select 'enterprise', 'view', 1000 union all select 'enterprise', 'error', 1000""",
    "subscriptions": """select c_custkey as subscription_id, c_nationkey % 5 as min_level_ord, c_acctbal > 0 as enabled,
       case c_custkey % 3 when 0 then '' when 1 then 'click,view' else 'error' end as symbols_csv,
       case c_custkey % 4 when 0 then 'data,risk' when 1 then 'risk,alert' when 2 then 'alert' else 'data' end as events_csv from customer""",
    "stock_quotes": """select p_partkey as symbol_id, p_retailprice as price, p_retailprice / (1.0 + (p_size - 25) / 500.0) as previous_close,
       case p_size % 6 when 0 then 'Tech' when 1 then 'Auto' when 2 then 'Finance' when 3 then 'Energy' when 4 then 'Healthcare' else 'Other' end as sector from part""",
    "news": "select doc_id as id, text as title, source, lang from documents",
    "venue_calls": "select event_id, exchange, ts, open_interest_usd / 10000.0 as latency_ms, symbol = 'error' as is_error from ticks",
}


def needed(sql: str) -> list[str]:
    """Names of the views a statement uses, in an order in which each follows what it reads."""
    out: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in out and re.search(rf"\b{name}\b", text):
                add(VIEWS[name])
                if name not in out:
                    out.append(name)

    add(sql)
    return out


def with_views(sql: str) -> str:
    """The statement with its views as common table expressions."""
    parts = [f"{n} as ({VIEWS[n]})" for n in needed(sql)]
    body = sql.strip()
    for head in ("with recursive ", "with "):
        if body.lower().startswith(head):
            parts.append(body[len(head) :].lstrip())
            return head + ",\n".join(parts)
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables of ``sf_dir``."""
    sql = with_views(f"select * from {name}")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if re.search(rf"\bfrom {t}\b", sql)}
    for t in tables:
        sql = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", sql)
    df = spark.sql(sql, **tables) if tables else spark.sql(sql)
    stamps = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in stamps})
