"""Outcomes of trades from a stream: keyed state per symbol, event-time timers.

The feed has candles, trades that were opened and the time of a poll, in any
order within the watermark's lateness.  A symbol's state holds its open trades,
the candles the watermark has not passed, its last close, and its clock, which
is its newest candle or poll.  Timers stand at every trade's end and at the
newest row of a batch; with them, and with every batch, a symbol goes on to the
watermark: in order of time, trades that end expire at the last close, once the
symbol's clock has come that far, and candles are held against the trades that
are still open.  A trade leaves the state when it closes and a candle when it is
used, so state is bounded by the trades open at once and the lateness.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.config import DEFAULT, Config
from tickloom.operators.ledger import profit_pct

FEED = ("kind", "symbol", "ts", "low", "high", "close", "signal_id", "entry_price", "stop_loss", "take_profit")
OUTCOME = "symbol string, signal_id string, status string, exit_reason string, exit_ms long, entry_price double, stop_loss double, take_profit double, exit_price double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def feed(trades: DataFrame | None = None, candles: DataFrame | None = None, polls: DataFrame | None = None) -> DataFrame:
    """One frame of trades (signal_id, symbol, entry_ts, entry_price, stop_loss, take_profit), candles (symbol, ts, low, high, close) and polls (symbol, as_of); each may be a stream."""
    out = None
    for kind, rows, names in (("trade", trades, {"entry_ts": "ts"}), ("candle", candles, {}), ("poll", polls, {"as_of": "ts"})):
        if rows is None:
            continue
        rows = rows.withColumnsRenamed(names).withColumn("kind", F.lit(kind))
        types = {"kind": "string", "symbol": "string", "ts": "timestamp", "signal_id": "string"}
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(types.get(c, "double")).alias(c) for c in FEED])
        out = rows if out is None else out.unionByName(rows)
    return out


class OutcomeResolver(StatefulProcessor):
    """First touch of stop or target after the entry, before *expiry_ms* have gone; then expired."""

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "signal_id string", "entry_ms long, entry double, stop double, target double")
        self.waiting = handle.getListState("waiting", "ms long, low double, high double, close double")
        self.last = handle.getValueState("last", "ms long, close double")
        self.clock = handle.getValueState("clock", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        yield self.advanced(key, passed)
        clock, due, candles = self.clock.get()[0] if self.clock.exists() else 0, {}, []
        for some in rows:
            # what the watermark has passed is settled
            for r in some[some["ms"] >= passed].itertuples(index=False):
                if r.kind == "trade":
                    if not self.open.containsKey((r.signal_id,)):
                        self.open.updateValue((r.signal_id,), (int(r.ms), float(r.entry_price), float(r.stop_loss), float(r.take_profit)))
                        due[int(r.ms) + self.expiry_ms] = None
                    continue
                clock = max(clock, int(r.ms))
                if r.kind == "candle":
                    candles.append((int(r.ms), float(r.low), float(r.high), float(r.close)))
        if candles:
            self.waiting.appendList(candles)
        if clock:
            self.clock.update((clock,))
            due[clock] = None
        for ms in due:
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the first of many timers settles all that the watermark has passed, so waiting candles are read once, not once a trade
        yield self.advanced(key, timerValues.getCurrentWatermarkInMs())

    def advanced(self, key, now: int) -> pd.DataFrame:
        """What closes up to *now*."""
        names, out = [c.split()[0] for c in OUTCOME.split(", ")], []
        held = list(self.waiting.get()) if self.waiting.exists() else []
        # a candle that repeats is the same candle
        candles = {c[0]: c[1:] for c in held if c[0] <= now}
        trades = {k[0]: v for k, v in self.open.iterator()}
        clock = min(now, self.clock.get()[0] if self.clock.exists() else 0)
        ends = {e + self.expiry_ms for e, *_ in trades.values() if e + self.expiry_ms <= clock}
        if not candles and not ends:
            return pd.DataFrame(out, columns=names)
        last = self.last.get() if self.last.exists() else None
        # a time meets the trades that were opened by then and are still open, not those that a large batch brings for later
        later, entered = sorted(trades.items(), key=lambda t: t[1][0], reverse=True), {}
        for ms in sorted({*candles, *ends}):
            while later and later[-1][1][0] <= ms:
                sid, trade = later.pop()
                entered[sid] = trade
            for sid, (entry_ms, entry, stop, target) in sorted(entered.items()):
                row = None
                if entry_ms + self.expiry_ms <= min(ms, clock):
                    row = ("EXPIRED", "TIMEOUT_48H", last[1] if last is not None and last[0] > entry_ms else entry)
                elif ms in candles and entry_ms < ms:
                    low, high, _ = candles[ms]
                    if low <= stop:
                        row = ("LOSS", "BOTH_HIT_CONSERVATIVE" if high >= target else "STOP_LOSS_HIT", stop)
                    elif high >= target:
                        row = ("WIN", "TAKE_PROFIT_HIT", target)
                if row:
                    out.append((key[0], sid, row[0], row[1], min(ms, entry_ms + self.expiry_ms), entry, stop, target, row[2]))
                    self.open.removeKey((sid,))
                    del entered[sid]
            if ms in candles:
                last = (ms, candles[ms][2])
        if last is not None:
            self.last.update(last)
        if candles:
            rest = [c for c in held if c[0] > now]
            self.waiting.put(rest) if rest else self.waiting.clear()
        return pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def resolve_stream(rows: DataFrame, lateness: str = "0 seconds", config: Config = DEFAULT) -> DataFrame:
    """(signal_id, symbol, status, exit_reason, exit_ts, exit_price, profit_pct) of a streaming ``feed``, a row when a trade closes.

    * rows later than *lateness* behind the newest one are left out by the
      watermark; a poll is what moves it where no candle comes any more;
    * a trade or candle that repeats counts once; rows without a symbol or time,
      and trades without an id, are left out; candles without prices touch nothing;
    * a candle that touches stop and target is a loss.

    The session keeps such state in RocksDB (``use_state``).
    """
    timed = rows.where("symbol is not null and ts is not null and (kind <> 'trade' or signal_id is not null)").withWatermark("ts", lateness)
    timed = timed.withColumn("ms", F.unix_millis("ts"))
    out = timed.groupBy("symbol").transformWithStateInPandas(OutcomeResolver(config.trade_expiry_hours * 3_600_000), OUTCOME, "Append", "EventTime")
    pct = profit_pct(F.col("status"), F.col("entry_price"), F.col("stop_loss"), F.col("take_profit"), F.col("exit_price"))
    return out.select("signal_id", "symbol", "status", "exit_reason", F.timestamp_millis("exit_ms").cast("timestamp_ntz").alias("exit_ts"), "exit_price", pct.alias("profit_pct"))


class use_state:
    """While it lasts, streams that start in the session keep their state in RocksDB."""

    def __init__(self, spark: SparkSession):
        self.spark, self.name = spark, "spark.sql.streaming.stateStore.providerClass"

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.name)
        self.spark.conf.set(self.name, ROCKS)

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(self.name, self.before)
