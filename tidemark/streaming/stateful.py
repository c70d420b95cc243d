"""Keyed streaming operators with state of their own: late rows, accepted prices in event time, and stress scores row by row.

State is kept per symbol by ``transformWithStateInPandas``, in small entries of which a batch rewrites only those it touches. Start queries within
``state_store``, as such state needs the RocksDB store.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.operators.folds import MAX_JUMP, accepts
from tidemark.operators.stress import scored_rows

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: For states of many keys: no key is looked up before each write only to count the keys, and a commit writes the changes alone.
MANY_KEYS = {"rocksdb.trackTotalNumberOfRows": "false", "rocksdb.changelogCheckpointing.enabled": "true"}


@contextmanager
def state_store(spark: SparkSession, settings: dict[str, str] | None = None) -> Iterator[None]:
    """Queries started within keep their state in RocksDB, with ``settings`` of the store if given."""
    names = {f"spark.sql.streaming.stateStore.{k}": v for k, v in {"providerClass": PROVIDER, **(settings or {})}.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class Arrivals(StatefulProcessor):
    """Tells rows that come too late for their symbol from those in time."""

    def __init__(self, names: list[str], delay_ms: int, ahead_ms: int) -> None:
        self.names, self.delay, self.ahead = names, delay_ms, ahead_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = self.newest.get()[0] if self.newest.exists() else None
        limit = None if newest is None else newest - self.delay
        for pdf in rows:
            pdf.columns = [*self.names, "_ms", "_now"]  # Spark renames columns that are no Python names
            at = pdf["_ms"]
            early = at > pdf["_now"] + self.ahead
            late = ~early & (at < limit) if limit is not None else early & False
            taken = at[~early]
            if len(taken):
                newest = int(taken.max()) if newest is None else max(newest, int(taken.max()))
            yield pdf.assign(arrival=np.where(early, "ahead", np.where(late, "late", "taken")).astype(object)).drop(columns=["_ms", "_now"])
        if newest is not None:
            self.newest.update((newest,))

    def close(self) -> None:
        pass


def arrivals(rows: DataFrame, delay_ms: int = 120_000, ahead_ms: int = 300_000, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """A stream of rows with ``arrival``: taken, late or ahead. No row is dropped.

    A symbol's watermark is the newest time that the batches before have brought, less ``delay_ms``; rows before it are late. Rows more than
    ``ahead_ms`` in the future are ahead and do not move it. Rows without a time are late.
    """
    marked = rows.withColumn("_ms", F.coalesce(F.unix_millis(ts), F.lit(-(1 << 53)))).withColumn("_now", F.unix_millis(F.current_timestamp()))
    schema = ", ".join(f"`{n}` {kind}" for n, kind in rows.dtypes)
    return marked.groupBy(key).transformWithStateInPandas(Arrivals(rows.columns, delay_ms, ahead_ms), f"{schema}, arrival string", "Append", "none")


def arrivals_to_tables(rows: DataFrame, base: str, checkpoint: str, key: str = "symbol", **how) -> StreamingQuery:
    """Work off a stream into ``base``/taken, /late (rows that are late or ahead) and /counts (rows by symbol and arrival), a folder a batch.

    A batch that is run again replaces its folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.filter("arrival = 'taken'").drop("arrival").write.mode("overwrite").parquet(f"{base}/taken/batch={number}")
        batch.filter("arrival <> 'taken'").write.mode("overwrite").parquet(f"{base}/late/batch={number}")
        batch.groupBy(key, "arrival").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{base}/counts/batch={number}")
        batch.unpersist()

    with state_store(rows.sparkSession):
        q = arrivals(rows, key=key, **how).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


class MarkFold(StatefulProcessor):
    """The fold of accepted prices: rows wait, by their time, until the watermark has passed them.

    Waiting rows lie in entries of an hour each, and one timer a symbol, at its earliest waiting row, releases all that is due.
    """

    HOUR_US = 3_600_000_000
    #: Rows that are taken in before they are written to their entries.
    HELD = 200_000

    def __init__(self, max_jump: float) -> None:
        self.max_jump = max_jump

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "price double")
        self.alarm = handle.getValueState("alarm", "ms long")
        self.waiting = handle.getMapState("waiting", "hour long", "us array<long>, prices array<double>")

    def _keep(self, us: np.ndarray, prices: np.ndarray) -> None:
        """Add rows to their hours' entries."""
        hours = us // self.HOUR_US
        order = np.argsort(hours, kind="stable")
        found, starts = np.unique(hours[order], return_index=True)
        for hour, own in zip(found.tolist(), np.split(order, starts[1:]), strict=True):
            at, p = us[own].tolist(), prices[own].tolist()
            if self.waiting.containsKey((hour,)):
                before = self.waiting.getValue((hour,))
                at, p = [*before[0], *at], [*before[1], *p]
            self.waiting.updateValue((hour,), (at, p))

    def _wake(self, us: int) -> None:
        """One timer, just past the earliest waiting row."""
        due = us // 1000 + 1
        if self.alarm.exists():
            if self.alarm.get()[0] <= due:
                return
            self.handle.deleteTimer(self.alarm.get()[0])
        self.handle.registerTimer(due)
        self.alarm.update((due,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, n, first = [], 0, None
        for pdf in rows:
            us, prices = pdf["us"].to_numpy(np.int64), pdf["mark_price"].to_numpy(float, na_value=np.nan)
            if not len(us):
                continue
            held.append((us, prices))
            n += len(us)
            first = int(us.min()) if first is None else min(first, int(us.min()))
            if n >= self.HELD:
                self._keep(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if held:
            self._keep(*map(np.concatenate, zip(*held, strict=True)))
        if first is not None:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All that is due, in order of time, an hour at a time."""
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        self.alarm.clear()
        last, rest = self.last.get()[0] if self.last.exists() else None, None
        hours = sorted(k[0] for k in self.waiting.keys())
        for hour in hours:
            if hour * self.HOUR_US >= limit:
                rest = min(self.waiting.getValue((hour,))[0])
                break
            entry = self.waiting.getValue((hour,))
            us, prices = np.array(entry[0], np.int64), np.array(entry[1], float)
            due = us < limit
            if due.all():
                self.waiting.removeKey((hour,))
            else:
                self.waiting.updateValue((hour,), (us[~due].tolist(), prices[~due].tolist()))
                rest = int(us[~due].min())
            us, prices = us[due], prices[due]
            kept = []
            for i in np.lexsort((prices, us)).tolist():
                p = float(prices[i])
                if 0 < p < math.inf and accepts(last, p, self.max_jump):
                    last = p
                    kept.append(i)
            if kept:
                yield pd.DataFrame({"symbol": pd.Series([key[0]] * len(kept), dtype=object), "us": us[kept], "mark_price": prices[kept]})
            if rest is not None:
                break
        if last is not None:
            self.last.update((last,))
        if rest is not None:
            self._wake(int(rest))

    def close(self) -> None:
        pass


def validated_marks(minutes: DataFrame, max_jump: float = MAX_JUMP, watermark: str = "2 minutes") -> DataFrame:
    """Prices within ``max_jump`` of the last accepted price of their symbol, folded in the order of event time.

    State of a symbol is that price and one entry for each hour that the watermark has not passed; a batch writes the entries it adds to, and a
    timer of the symbol releases what is due.
    """
    rows = minutes.filter(F.unix_millis("ts") <= F.unix_millis(F.current_timestamp()) + 300_000).withWatermark("ts", watermark)
    rows = rows.select("symbol", "ts", F.unix_micros("ts").alias("us"), "mark_price")
    out = rows.groupBy("symbol").transformWithStateInPandas(MarkFold(max_jump), "symbol string, us long, mark_price double", "Append", "eventTime")
    return out.select("symbol", F.timestamp_micros("us").alias("ts"), "mark_price")


class Ordered:
    """A window's values in order."""

    def __init__(self, values) -> None:
        self.v = np.sort(values[~np.isnan(values)])

    def add(self, x: float) -> None:
        if x == x:
            self.v = np.insert(self.v, np.searchsorted(self.v, x), x)

    def remove(self, x: float) -> None:
        if x == x:
            self.v = np.delete(self.v, np.searchsorted(self.v, x))

    def quantile(self, q: float) -> float:
        if not len(self.v):
            return math.nan
        at = q * (len(self.v) - 1)
        i = int(at)
        low = float(self.v[i])
        return low if at == i else low + (float(self.v[i + 1]) - low) * (at - i)

    def share_up_to(self, x: float) -> float:
        return float(np.searchsorted(self.v, x, "right")) / len(self.v) * 100.0


class StressScores(StatefulProcessor):
    """Rolling statistics of a symbol's deviations, row by row, over the last ``history`` rows.

    The rows are a ring of blocks in a map, BLOCK rows an entry: a batch writes the last blocks and removes those that have left the window.
    """

    BLOCK = 512
    COLUMNS = "symbol string, ts timestamp, x double, rn long, zb double, vol_of_stress double, x_q90 double, x_q95 double, x_q99 double, x_rank double, zb_q33 double, zb_q67 double"

    def __init__(self, history: int, lookback: int) -> None:
        self.history, self.lookback = history, lookback

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "rows long, ts timestamp")
        self.ring = handle.getMapState("ring", "block long", "x array<double>, z array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("ts", kind="stable")
        done, newest = self.place.get() if self.place.exists() else (0, None)
        if newest is not None:
            pdf = pdf[pdf["ts"] > newest]
        if not len(pdf):
            return
        fresh = pdf["deviation"].fillna(0.0).to_numpy(float)
        first = max(0, done - max(self.history, self.lookback)) // self.BLOCK
        there = [self.ring.getValue((b,)) for b in range(first, -(-done // self.BLOCK))]
        blank = np.full(len(fresh), np.nan)
        x = np.concatenate([*(np.array(t[0], float) for t in there), fresh])
        z = np.concatenate([*(np.array([math.nan if v is None else v for v in t[1]], float) for t in there), blank])
        start = first * self.BLOCK  # number of the row at x[0]
        at = done - start
        xs, zs = Ordered(x[max(0, at - self.history) : at]), Ordered(z[max(0, at - self.history) : at])
        out = []
        for i in range(at, len(x)):
            if i - self.history >= 0:
                xs.remove(x[i - self.history])
                zs.remove(z[i - self.history])
            xs.add(x[i])
            if start + i:
                w = x[max(0, i - self.history + 1) : i + 1]
                spread = float(np.std(w)) if xs.v[0] < xs.v[-1] else 0.0
                z[i] = (x[i] - float(np.mean(w))) / spread if spread > 0 else 0.0
                zs.add(z[i])
            back = z[max(0, i - self.lookback + 1) : i + 1]
            back = back[~np.isnan(back)]
            out.append((start + i + 1, z[i], float(np.std(back)) if len(back) else 0.0, *(xs.quantile(q) for q in (0.9, 0.95, 0.99)), xs.share_up_to(x[i]), zs.quantile(0.33), zs.quantile(0.67)))
        total = start + len(x)
        for b in range(done // self.BLOCK, -(-total // self.BLOCK)):
            part = slice(b * self.BLOCK - start, min(len(x), (b + 1) * self.BLOCK - start))
            self.ring.updateValue((b,), (x[part].tolist(), [None if v != v else float(v) for v in z[part]]))
        for b in range(first, max(0, total - max(self.history, self.lookback)) // self.BLOCK):
            self.ring.removeKey((b,))
        self.place.update((total, pdf["ts"].iloc[-1].to_pydatetime()))
        names = ("rn", "zb", "vol_of_stress", "x_q90", "x_q95", "x_q99", "x_rank", "zb_q33", "zb_q67")
        columns = dict(zip(names, zip(*out, strict=True), strict=True))
        yield pd.DataFrame({"symbol": pd.Series([key[0]] * len(fresh), dtype=object), "ts": pdf["ts"].to_numpy(), "x": fresh, **columns})

    def close(self) -> None:
        pass


def stress_scores(deviations: DataFrame, history: int = 43_200, warm: int = 1440, lookback: int = 4320, z_scale: float = 20.0) -> DataFrame:
    """A stream of (symbol, ts, deviation) scored row by row, as ``stress.stress_score`` scores a table.

    A symbol's rows are scored in order of time; rows that are not newer than its last scored one are left out (``arrivals`` sets them apart).
    State of a symbol is bounded by ``history`` rows.
    """
    rows = deviations.select("symbol", "ts", "deviation")
    found = rows.groupBy("symbol").transformWithStateInPandas(StressScores(history, lookback), StressScores.COLUMNS, "Append", "none")
    null = found.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if c in ("zb", "zb_q33", "zb_q67") else F.col(c) for c in found.columns])
    return scored_rows(null, history, warm, z_scale)


def stress_to_table(deviations: DataFrame, path: str, checkpoint: str, **how) -> StreamingQuery:
    """Work off what is there; the files are exactly-once by the checkpoint, and a restart goes on from the state."""
    with state_store(deviations.sparkSession):
        q = stress_scores(deviations, **how).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
