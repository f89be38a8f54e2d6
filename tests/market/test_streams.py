"""Streams with state, late ticks, and tables that are written exactly once."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import ledger
from tickloom.sources import market
from tickloom.sources.versions import VersionedTable
from tickloom.streaming import resolver
from tickloom.streaming.late import RevisedBars
from tickloom.streaming.ledger_table import LedgerTable

T0 = dt.datetime(2025, 1, 6)


def hour(n):
    return T0 + dt.timedelta(hours=n)


def test_resolver_that_is_stopped_equals_replay(spark, tmp_path):
    """Slices out of order within the lateness, a candle and a trade twice, a stop after the first batches."""
    import random

    rnd, price, candles, trades = random.Random(3), 100.0, [], []
    for n in range(160):
        price += rnd.uniform(-1, 1)
        for symbol, shift in (("A", 0), ("B", 7)):
            candles.append((symbol, hour(n), price + shift - rnd.random(), price + shift + rnd.random(), price + shift))
            if n % 7 == 0:
                w = 0.004 if n % 2 else 0.05
                trades.append((f"{symbol}{n}", symbol, hour(n), price + shift, (price + shift) * (1 - w), (price + shift) * (1 + 2 * w)))
    candles = [c for c in candles if not (c[0] == "B" and c[1] > hour(120))]  # B ends early
    c = spark.createDataFrame(candles, "symbol string, ts timestamp_ntz, low double, high double, close double")
    t = spark.createDataFrame(trades, "signal_id string, symbol string, entry_ts timestamp_ntz, entry_price double, stop_loss double, take_profit double")
    as_of = c.groupBy("symbol").agg((F.max("ts") + F.expr("interval 1 hour")).alias("as_of"), F.max_by("close", "ts").alias("last_close"))
    cols = ["signal_id", "status", "exit_reason", "exit_price", "profit_pct"]
    want = {tuple(r) for r in ledger.resolve_replay(t, c, as_of).select(*cols).collect()}
    assert {w[1] for w in want} == {"WIN", "LOSS", "EXPIRED", "OPEN"}
    rows = resolver.feed(t, c, as_of).unionByName(resolver.feed(t.limit(3), c.limit(5)))
    late = F.col("ts") + F.make_dt_interval(hours=F.pmod(F.xxhash64("symbol", "ts", "kind"), F.lit(3)).cast("int"))
    rows = rows.withColumn("slice", F.least(F.floor((F.unix_seconds(late) - F.lit(int(T0.replace(tzinfo=dt.UTC).timestamp()))) / 3600 / 60), F.lit(2))).cache()

    with resolver.use_state(spark):
        for slices in ([0], [1, 2]):
            for k in slices:
                rows.where(F.col("slice") == k).drop("slice").coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
            s = spark.readStream.schema(rows.drop("slice").schema).parquet(f"{tmp_path}/in")
            q = resolver.resolve_stream(s, lateness="4 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
            q.trigger(availableNow=True).start().awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != resolver.ROCKS
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select(*cols).collect()}
    still = {w for w in want if w[1] == "OPEN"}
    # the watermark is 4 hours behind: what closes after it is open
    missing = want - still - got
    assert got <= want and len(got) == spark.read.parquet(f"{tmp_path}/out").count() and len(missing) <= 3 and len(got) > 30


class _Held:
    """State of one key in plain Python; reads counts the rows that were read."""

    def __init__(self):
        self.rows, self.map, self.reads = None, {}, 0

    getMapState = getListState = getValueState = lambda self, *_: _Held()

    def exists(self):
        return self.rows is not None

    def get(self):
        self.reads += len(self.rows)
        return self.rows

    def update(self, row):
        self.rows = row

    def put(self, rows):
        self.rows = list(rows)

    appendList = put

    def clear(self):
        self.rows = None

    def containsKey(self, k):
        return k in self.map

    def updateValue(self, k, v):
        self.map[k] = v

    def removeKey(self, k):
        del self.map[k]

    def iterator(self):
        return iter(list(self.map.items()))

    def registerTimer(self, ms):
        self.map[ms] = None


def test_large_batch_reads_waiting_candles_once():
    """Every timer read all waiting candles of the batch, so a batch of n candles and trades took n * n steps."""
    hour, n, handle, r = 3_600_000, 2000, _Held(), resolver.OutcomeResolver(48 * 3_600_000)
    r.init(handle)
    candle = lambda k: {"kind": "candle", "ms": k * hour, "low": 99.0 - (k % 7 == 0) * 2, "high": 101.0 + (k % 11 == 0) * 2, "close": 100.0 + k % 3}
    trade = lambda k: {"kind": "trade", "ms": k * hour, "signal_id": f"t{k}", "entry_price": 100.0, "stop_loss": (98.0, 50.0)[k % 8 == 0], "take_profit": (102.0, 150.0)[k % 8 == 0]}
    rows = pd.DataFrame([candle(k) for k in range(1, n)] + [trade(k) for k in range(4, n, 4)])
    at = lambda ms: type("T", (), {"getCurrentWatermarkInMs": lambda _: ms, "getExpiryTimeInMs": lambda _: ms})()
    out = list(r.handleInputRows(("A",), iter([rows]), at(0)))
    end = (n - 1) * hour
    for ms in sorted(t for t in handle.map if t <= end):
        out += list(r.handleExpiredTimer(("A",), at(end), at(ms)))
    assert r.waiting.reads == n - 1
    closed = pd.concat(out).set_index("signal_id")["exit_reason"]
    want = {}
    for k in range(4, n, 4):
        hit = [(j, j % 7 == 0, j % 11 == 0) for j in range(k + 1, min(k + 48, n)) if k % 8 and (j % 7 == 0 or j % 11 == 0)]
        if hit:
            want[f"t{k}"] = "BOTH_HIT_CONSERVATIVE" if hit[0][1] and hit[0][2] else "STOP_LOSS_HIT" if hit[0][1] else "TAKE_PROFIT_HIT"
        elif k + 48 <= n - 1:
            want[f"t{k}"] = "TIMEOUT_48H"
    assert closed.to_dict() == want


def test_late_and_repeated_ticks(spark, tmp_path):
    rows = [("A", k, hour(0) + dt.timedelta(minutes=13 * k), 100.0 + (k * 37 % 11)) for k in range(60)]
    ticks = spark.createDataFrame([*rows, (None, 99, hour(1), 5.0), ("A", None, hour(1), 5.0), ("A", 98, None, 5.0)], "symbol string, event_id long, ts timestamp_ntz, price double")
    want = {tuple(r) for r in market.bars(ticks.where("symbol is not null and event_id is not null and ts is not null"), 60, "1H").collect()}
    t = RevisedBars(spark, str(tmp_path), 60, "1H")
    assert t.revise(ticks.where("event_id % 3 = 1"), 0) and t.revise(ticks.where("event_id % 3 <> 1 or event_id is null"), 1)
    assert {tuple(r) for r in t.bars().collect()} == want
    first = {tuple(r) for r in t.bars(upto=0).collect()}
    assert first != want and first == {tuple(r) for r in market.bars(ticks.where("event_id % 3 = 1"), 60, "1H").collect() if r["ts"]}
    # the same batch again, and the same ticks as another batch with another price
    assert not t.revise(ticks.limit(1), 1)
    assert t.revise(ticks.where("event_id = 4").withColumn("price", F.lit(1e6)), 2)
    assert {tuple(r) for r in t.bars().collect()} == want
    # a batch whose ticks were written, but not its bars
    t.ticks.commit(spark.createDataFrame([("A", 500, hour(2), 1.0, hour(2).date())], "symbol string, event_id long, ts timestamp_ntz, price double, day date"), 3)
    assert {tuple(r) for r in t.bars().collect()} == want
    assert t.revise(spark.createDataFrame([("A", 500, hour(2), 1.0)], ticks.schema), 3)
    assert {r["low"] for r in t.bars().where(F.col("ts") == hour(2)).collect()} == {1.0}
    with pytest.raises(ValueError):
        RevisedBars(spark, str(tmp_path), 7)


def test_batch_that_fails_and_is_repeated(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path), "k string, v int")
    assert t.read().count() == 0 and t.entries() == []
    assert t.commit(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), 0)
    # rows are written, then the process dies before the log has them
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_enter", lambda *a: (_ for _ in ()).throw(RuntimeError("died")))
        with pytest.raises(RuntimeError):
            t.commit(spark.createDataFrame([("a", 2)], "k string, v int"), 1)
    assert sorted((r["k"], r["v"]) for r in t.read().collect()) == [("a", 1), ("b", 1)]
    before = t.read()
    assert t.commit(spark.createDataFrame([("a", 2)], "k string, v int"), 1) and not t.commit(spark.createDataFrame([("z", 9)], "k string, v int"), 1)
    # a reader keeps the version it opened
    assert before.count() == 2 and t.read().count() == 3
    assert sorted(tuple(r) for r in t.newest(["k"]).collect()) == [("a", 2), ("b", 1)] and t.read(upto=0).count() == 2
    assert t.commit(t.newest(["k"]), 2, replaces=True)
    assert t.read().count() == 2 and len(t.vacuum()) == 3 and sorted(tuple(r) for r in t.newest(["k"]).collect()) == [("a", 2), ("b", 1)]
    # missing columns are null, others are left out
    assert t.commit(spark.createDataFrame([("c", 5)], "k string, w int"), 3)
    assert [tuple(r) for r in t.newest(["k"]).where("k = 'c'").collect()] == [("c", None)]


def test_ledger_table(spark, tmp_path):
    t = LedgerTable(spark, str(tmp_path))
    signals = spark.createDataFrame([("1", "XAU", None), ("2", "XAU", "news"), ("2", "XAU", "news"), (None, "XAU", None)], "signal_id string, symbol string, blocked_reason string")
    assert t.log(signals, 1)
    outcome = "signal_id string, status string, exit_price double, exit_ts timestamp_ntz, exit_reason string, profit_pct double"
    won = spark.createDataFrame([("1", "WIN", 5.0, T0, "TAKE_PROFIT_HIT", 2.5), ("2", "WIN", 5.0, T0, "x", 1.0), ("9", "WIN", 5.0, T0, "x", 1.0)], outcome)
    assert t.close(won, 2) and not t.close(won, 2)
    # the signal is sent again when its trade has closed: it stays closed
    assert t.log(signals, 3)
    rows = {r["signal_id"]: r for r in t.current().collect()}
    assert rows.keys() == {"1", "2"} and (rows["1"]["status"], rows["1"]["profit_pct"], rows["2"]["status"], rows["2"]["blocked_reason"]) == ("WIN", "2.5", "BLOCKED", "news")
    assert t.current(upto=1).where("status = 'OPEN'").count() == 1
    assert t.compact(4) and sorted(map(str, t.current().collect())) == sorted(map(str, rows.values()))
    made = LedgerTable(spark, f"{tmp_path}/b")
    assert made.log(signals.drop("signal_id").withColumn("timestamp", F.lit("2025-01-01")), 1)
    assert len(made.current().first()["signal_id"]) == 8

