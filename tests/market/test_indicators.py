import datetime as dt
import random

import pytest

from tickloom.functions.rolling import blocks_for, ewm, indexed, recursions, wilder
from tickloom.operators import indicators as ind

T0 = dt.datetime(2025, 1, 1)
SCHEMA = "symbol string, tf string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def frame(spark, closes, symbol="S"):
    return spark.createDataFrame([(symbol, "1H", T0 + dt.timedelta(hours=i), c, c + 1.0, c - 1.0, c, float(i % 5)) for i, c in enumerate(closes)], SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("ts").collect()]


def test_recursions_over_several_blocks(spark):
    rng = random.Random(1)
    xs = [2400 + rng.gauss(0, 5) for _ in range(3000)]
    df = indexed(frame(spark, xs))
    for alpha in (2 / 13, 2 / 51, 1 / 14):
        y, want = None, []
        for x in xs:
            y = x if y is None else (1 - alpha) * y + alpha * x
            want.append(y)
        got = column(ewm(df, {"y": (df["close"], alpha)}), "y")
        assert max(abs(a - b) for a, b in zip(got, want, strict=True)) < 1e-9
    y, want = None, []
    for i, x in enumerate(xs):
        y = None if i < 13 else sum(xs[:14]) / 14 if i == 13 else y * 13 / 14 + x / 14
        want.append(y)
    got = column(wilder(df, {"y": df["close"]}, 14, 13), "y")
    assert got[:13] == [None] * 13 and max(abs(a - b) for a, b in zip(got[13:], want[13:], strict=True)) < 1e-9


def test_recursions_of_every_span(spark):
    """Spans whose blocks have 1 to 50,000 rows, alone and in one call, against the plain loop."""
    rng = random.Random(2)
    xs = [2400 + rng.gauss(0, 5) for _ in range(5000)]
    df = indexed(frame(spark, xs))
    spans = (1, 2, 3, 200, 1000, 10**7)
    got = ewm(df, {f"y{n}": (df["close"], 2 / (n + 1)) for n in spans}).orderBy("ts").collect()
    for n in spans:
        a, y = 2 / (n + 1), None
        for r, x in zip(got, xs, strict=True):
            y = x if y is None else (1 - a) * y + a * x
            assert abs(r[f"y{n}"] - y) < 1e-9
    total = recursions(df, {"s": (df["close"], 1.0), "t": (df["close"], 0.0)}).orderBy("ts").collect()
    assert abs(total[-1]["s"] - sum(xs)) < 1e-6 and [r["t"] for r in total] == xs
    for rows, names in blocks_for({str(n): 1 - 2 / (n + 1) for n in spans[1:]}):
        assert all(1e-290 < (1 - 2 / (int(k) + 1)) ** rows <= 1e-20 for k in names)
    with pytest.raises(ValueError):
        recursions(df, {"s": (df["close"], 1.5)})


def test_macro_row_in_force(spark):
    """The newest macro row at or before each bar, also from days before, against a loop."""
    rng = random.Random(3)
    df = frame(spark, [100.0] * 240)
    macro = [(T0 + dt.timedelta(minutes=rng.randint(30 * 60, 200 * 60)), float(k), 0.5, 40.0 + k) for k in range(12)]
    for rows in (macro, []):
        got = ind.with_macro(df, spark.createDataFrame(rows, "ts timestamp_ntz, usd_strength double, real_rates_momentum double, risk_sentiment double")).orderBy("ts").collect()
        assert len(got) == 240
        for r in got:
            held = max((m for m in rows if m[0] <= r["ts"]), default=(None, 0.0, 0.0, 50.0))
            assert (r["usd_strength"], r["real_rates_momentum"], r["risk_sentiment"]) == held[1:]


@pytest.mark.parametrize("closes, simple, smoothed", [([100.0 + i for i in range(20)], 100.0, 100.0), ([100.0 - i for i in range(20)], 0.0, 0.0), ([100.0] * 20, None, 100.0)])
def test_rsi_of_one_way_markets(spark, closes, simple, smoothed):
    df = indexed(frame(spark, closes))
    a, b = column(ind.rsi_simple(df), "rsi_14"), column(ind.rsi_wilder(df), "rsi_wilder")
    assert a[12] is None and a[13] == simple and a[-1] == simple
    assert b[12] is None and b[13] == pytest.approx(smoothed)


def test_first_known_rows(spark):
    df = indexed(frame(spark, [100.0 + (i * 7) % 11 for i in range(60)]))
    first = lambda f, c: next(i for i, v in enumerate(column(f(df), c)) if v is not None)
    assert first(ind.atr_simple, "atr_14") == 13 and first(ind.adx_simple, "plus_di") == 14 and first(ind.adx_simple, "adx_14") == 27
    assert first(ind.momentum, "volatility") == 20 and first(ind.adx_wilder, "adx_wilder") == 27 and first(ind.moving_averages, "ma50") == 49
    assert column(ind.atr_wilder(df), "atr_wilder")[:13] == [0.0] * 13


def test_flat_prices_and_zero_volume(spark):
    df = indexed(frame(spark, [100.0] * 30))
    assert set(column(ind.bollinger(df), "bb_position")) == {None}
    assert column(ind.bollinger(df, pad=1e-6), "bb_position")[-1] == 0.0
    still = df.withColumn("volume", df["volume"] * 0)
    assert set(column(ind.volume_spike(still), "volume_ratio")) == {1.0} and set(column(ind.volume_spike(still), "volume_spike")) == {None}


def test_feature_frames(spark):
    df = frame(spark, [100.0 + (i * 7) % 11 for i in range(80)])
    gold, base = ind.gold_features(df), ind.base_features(df)
    assert set(ind.GOLD_FEATURES) <= set(gold.columns) and len(ind.GOLD_FEATURES) == 20 and set(ind.BASE_FEATURES) <= set(base.columns) and len(ind.BASE_FEATURES) == 17
    full = ind.filled(gold, ind.GOLD_FEATURES)
    assert full.dropna(subset=list(ind.GOLD_FEATURES)).count() == 80
    assert column(full, "adx_14")[0] == column(gold, "adx_14")[27]
    assert 0 < ind.drop_warmup(gold, ind.GOLD_FEATURES).count() < 80


def test_fill_back_reads_a_series_once(spark):
    """Values of a loop, and no window from the row to the series' end: that took n * n steps, so long series did not end."""
    rng = random.Random(4)
    rows = [(s, "1H", T0 + dt.timedelta(hours=i), None if rng.random() < 0.6 or i > 280 else float(i)) for s in ("A", "B", None) for i in range(300)]
    df = spark.createDataFrame(rows, "symbol string, tf string, ts timestamp_ntz, x double").repartition(3)
    got = ind.filled(df, ("x",))
    want = {(s, ts): next((y for a, _, at, y in rows if a == s and at >= ts and y is not None), 0.0) for s, _, ts, _ in rows}
    assert {(r["symbol"], r["ts"]): r["x"] for r in got.collect()} == want
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_macro_is_carried_forward(spark):
    df = indexed(frame(spark, [1.0] * 6))
    macro = spark.createDataFrame([(T0 + dt.timedelta(hours=2), 0.3, -0.2, 75.0), (T0 + dt.timedelta(hours=4), 0.6, 0.2, 50.0)], "ts timestamp_ntz, usd_strength double, real_rates_momentum double, risk_sentiment double")
    assert column(ind.with_macro(df, macro), "usd_strength") == [0.0, 0.0, 0.3, 0.3, 0.6, 0.6]


def test_empty_and_null(spark):
    assert ind.gold_features(spark.createDataFrame([], SCHEMA)).count() == 0
    df = indexed(spark.createDataFrame([("S", "1H", T0 + dt.timedelta(hours=i), 1.0, 2.0, 0.5, 1.0 + i % 2, None) for i in range(30)], SCHEMA))
    assert set(column(ind.volume_spike(df), "volume_spike")) == {None}
