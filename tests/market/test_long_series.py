"""Long series in chunks, first matches by a tree, histories, alignment, and the data source of candles."""

import contextlib
import datetime as dt
import io
import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import chunks, rolling
from tickloom.operators import indicators, long_series, structure
from tickloom.sources import broker

T0 = dt.datetime(2025, 1, 6)


def series(spark, n, seed=1, symbols=("A",)):
    rows = []
    for symbol in symbols:
        rnd, price = random.Random(f"{seed}{symbol}"), 100.0
        for k in range(n):
            o, price = price, round(price + rnd.choice((-0.5, -0.25, 0, 0.25, 0.5)), 4)
            rows.append((symbol, "1H", T0 + dt.timedelta(hours=k), o, max(o, price) + rnd.choice((0, 0.25)), min(o, price) - rnd.choice((0, 0.25)), price, float(rnd.randint(1, 9))))
    return spark.createDataFrame(rows, "symbol string, tf string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_places(spark):
    df = series(spark, 700, symbols=("A", "B", "C\x1fD"))
    want = {tuple(r) for r in rolling.indexed(df).select("symbol", "ts", "i", "n").collect()}
    assert {tuple(r) for r in chunks.placed(df.repartition(5)).select("symbol", "ts", "i", "n").collect()} == want


def test_chunks_give_what_whole_series_give(spark):
    df = rolling.indexed(series(spark, 900, symbols=("A", "B\x1fC"))).cache()
    run = lambda d: indicators.rsi_wilder(structure.swings(d), n=3)
    got = chunks.in_chunks(df, run, rows=150, before=chunks.fading(2 / 3), after=3)
    cols = ["symbol", "tf", "ts", "i", "swing_high", "swing_low", F.round("rsi_wilder", 9).alias("rsi")]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, run(df).select(*cols).collect()))
    assert chunks.fading(0) == 1
    for bad in (1.0, -0.1):
        with pytest.raises(ValueError):
            chunks.fading(bad)
    with pytest.raises(ValueError):
        chunks.in_chunks(df, run, rows=10, before=11)


@pytest.mark.parametrize(("fanout", "depth"), [(4, 1), (4, 2), (3, 4), (512, 1)])
def test_tree_finds_the_first_close(spark, monkeypatch, fanout, depth):
    monkeypatch.setattr(long_series, "FANOUT", fanout)
    df = rolling.indexed(series(spark, 400, seed=fanout, symbols=("A", "B")))
    levels = df.where("i % 3 = 0").select("symbol", "tf", F.col("i").alias("from_i"), F.col("high").alias("level"), F.col("low").alias("carried"))
    got = {(r["symbol"], r["from_i"]): (r["j"], r["carried"]) for r in long_series.first_close_above(levels, df, depth).collect()}
    rows = {}
    for r in df.orderBy("symbol", "i").collect():
        rows.setdefault(r["symbol"], []).append(r)
    want = {}
    for s, bars in rows.items():
        for b in bars[::3]:
            j = next((x["i"] for x in bars[b["i"] + 1 :] if x["close"] > b["high"]), None)
            if j is not None:
                want[s, b["i"]] = (j, b["low"])
    assert got == want and want
    swung = structure.swings(df)
    assert sorted(map(str, structure.bos_up(swung, depth=depth).collect())) == sorted(map(str, structure.bos_up(swung).collect()))


def test_histories_are_what_every_prefix_says(spark):
    df = rolling.indexed(series(spark, 90, seed=5))
    df = df.withColumns({c: F.col(c) + F.pmod("i", F.lit(30)) * 0.25 for c in ("open", "high", "low", "close")}).cache()
    swung = structure.swings(df)
    got = {r["i"]: (r["bos_index"], r["broken_level"], r["swing_high_index"]) for r in long_series.bos_history(swung).collect()}
    from tickloom.config import Config

    config = Config(gap_least=0.0, gap_age=12)
    gaps = {r["i"]: (r["fvg_index"], r["fvg_low"], r["fvg_high"]) for r in long_series.gap_history(df, config).collect()}
    for k in range(10, 90, 7):
        prefix = rolling.indexed(df.where(F.col("i") <= k).drop("i", "n"))
        r = structure.bos_up(structure.swings(prefix)).first()
        assert got.get(k) == (None if r is None else (r["bos_index"], r["broken_level"], r["swing_high_index"])), k
        g = structure.fvg_up(prefix, config).first()
        assert gaps.get(k) == (None if g is None else (g["fvg_index"], g["fvg_low"], g["fvg_high"])), k
    assert got and gaps and long_series.bos_history(swung.where("false")).count() == 0


def test_alignment_looks_at_ended_bars_only(spark):
    at = lambda h, m=0: T0 + dt.timedelta(hours=h, minutes=m)
    rows = [("A", "15M", at(0, 15 * k), float(k)) for k in range(9)] + [("A", "1H", at(0), 10.0), ("A", "1H", at(1), 11.0), ("B", "1H", at(0), 99.0)]
    df = spark.createDataFrame(rows, "symbol string, tf string, ts timestamp_ntz, close double")
    got = {r["ts"]: (r["close_15m"], r["close_1h"]) for r in long_series.aligned(df, df, {"15M": 15, "1H": 60}, "close", "15M").collect()}
    assert got == {at(0, 15 * k): (float(k), None if k < 3 else 10.0 if k < 7 else 11.0) for k in range(9)}


class Flaky(broker.Store):
    """Fails as often as it is told, by series; bars k = 0..59."""

    def __init__(self, fails, counter):
        self.fails, self.counter = fails, counter

    def series(self):
        return [("A", "1H"), ("A", "4H"), ("B", "1H")]

    def newest(self, symbol, tf, end, count):
        import os
        import uuid

        import pyarrow as pa

        folder = f"{self.counter}/{symbol}-{tf}"
        os.makedirs(folder, exist_ok=True)
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        if len(os.listdir(folder)) <= self.fails.get(symbol, 0):
            raise OSError("no answer")
        ts = [T0 + dt.timedelta(hours=k) for k in range(60) if end is None or T0 + dt.timedelta(hours=k) < end][-count:]
        return pa.table({"ts": pa.array(ts, pa.timestamp("us")), **{c: [float(t.hour) for t in ts] for c in broker.PRICES}})


def test_source_pushes_filters_and_tries_again(spark, tmp_path):
    import os
    import sys

    # tasks find this test's store by value
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    name = broker.register(spark, Flaky({"A": 2, "B": 3}, str(tmp_path)), "flaky")
    read = lambda **o: spark.read.format(name).options(wait="0.01", least='{"1H": 20, "4H": 61}', **o).load()
    df = read(count="30").where("tf = '1H' and ts >= timestamp_ntz '2025-01-08 00:00:00' and close > 3")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    pushed = next(line for line in out.getvalue().splitlines() if "PushedFilters" in line)
    assert "tf" in pushed and "ts" in pushed and "close" not in pushed
    got = df.collect()
    # A answers at the third attempt, B never does; 4H is not asked
    assert {r["symbol"] for r in got} == {"A"} and min(r["ts"] for r in got) == T0 + dt.timedelta(hours=52) and max(r["ts"] for r in got) == T0 + dt.timedelta(hours=58)
    assert {f: len(os.listdir(tmp_path / f)) for f in os.listdir(tmp_path)} == {"A-1H": 3, "B-1H": 3}
    # the fourth question of B is answered; too few bars are no rows; end and count go to the store
    some = read(count="25", end="2025-01-07T06:00:00").collect()
    assert {(r["symbol"], r["tf"]) for r in some} == {("A", "1H"), ("B", "1H")} and max(r["ts"] for r in some) == T0 + dt.timedelta(hours=28) and len(some) == 48
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
