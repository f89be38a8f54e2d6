"""Technical indicators over candles, per (symbol, tf)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import DEFAULT, Config
from tickloom.functions.rolling import ewm, ewm_from, fill_back, flag, indexed, lag, ratio, rolling_mean, rolling_std, rolling_sum, series, wilder

def close() -> Column:
    return F.col("close")


def high() -> Column:
    return F.col("high")


def low() -> Column:
    return F.col("low")


def volume() -> Column:
    return F.col("volume")


def change(x: Column | None = None) -> Column:
    x = close() if x is None else x
    return x - lag(x)


def true_range() -> Column:
    before = lag(close())
    return F.greatest(high() - low(), F.abs(high() - before), F.abs(low() - before))


def moving_averages(df: DataFrame) -> DataFrame:
    """ma20, ma50 of closes, volume_ma20 and the flags close above them."""
    df = df.withColumn("ma20", rolling_mean(close(), 20)).withColumn("ma50", rolling_mean(close(), 50)).withColumn("volume_ma20", rolling_mean(volume(), 20))
    return df.withColumn("close_above_ma20", flag(close() > F.col("ma20"))).withColumn("close_above_ma50", flag(close() > F.col("ma50")))


def bollinger(df: DataFrame, population: bool = False, pad: float = 0.0) -> DataFrame:
    """bb_mid, bb_upper, bb_lower, bb_width, bb_position (0 to 1); *pad* is added to the range."""
    df = df.withColumn("bb_mid", rolling_mean(close(), 20)).withColumn("__s", rolling_std(close(), 20, population))
    df = df.withColumn("bb_upper", F.col("bb_mid") + 2 * F.col("__s")).withColumn("bb_lower", F.col("bb_mid") - 2 * F.col("__s"))
    width = F.col("bb_upper") - F.col("bb_lower")
    inside = ratio(close() - F.col("bb_lower"), width + F.lit(pad))
    df = df.withColumn("bb_width", width).withColumn("bb_position", F.when(inside.isNotNull(), F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0))))
    return df.withColumn("close_above_bb_upper", flag(close() > F.col("bb_upper"))).withColumn("close_above_bb_lower", flag(close() > F.col("bb_lower"))).drop("__s")


def _rsi(gain: Column, loss: Column) -> Column:
    return F.when(loss > 0, 100 - 100 / (1 + gain / loss)).when((loss == 0) & (gain > 0), F.lit(100.0))


def rsi_simple(df: DataFrame, n: int = 14) -> DataFrame:
    """rsi of plain means; the first change counts as none; no gain and no loss: null."""
    df = df.withColumn("__d", change())
    up, down = F.coalesce(F.greatest("__d", F.lit(0.0)), F.lit(0.0)), F.coalesce(F.greatest(-F.col("__d"), F.lit(0.0)), F.lit(0.0))
    df = df.withColumn("__up", up).withColumn("__down", down)
    return df.withColumn("rsi_14", _rsi(rolling_mean(F.col("__up"), n), rolling_mean(F.col("__down"), n))).drop("__d", "__up", "__down")


def rsi_wilder(df: DataFrame, n: int = 14, name: str = "rsi_wilder") -> DataFrame:
    """rsi of exponential means with alpha 1/n from the first change on, known from the n-th row; no loss: 100."""
    df = df.withColumn("__d", F.coalesce(change(), F.lit(0.0)))
    df = ewm(df, {"__up": (F.greatest("__d", F.lit(0.0)), 1 / n), "__down": (F.greatest(-F.col("__d"), F.lit(0.0)), 1 / n)})
    value = F.when(F.col("__down") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + F.col("__up") / F.nullif("__down", F.lit(0.0))))
    return df.withColumn(name, F.when(F.col("i") >= n - 1, value)).drop("__d", "__up", "__down")


def atr_simple(df: DataFrame, n: int = 14) -> DataFrame:
    df = df.withColumn("__tr", true_range())
    return df.withColumn("atr_14", rolling_mean(F.col("__tr"), n)).drop("__tr")


def atr_wilder(df: DataFrame, n: int = 14, name: str = "atr_wilder") -> DataFrame:
    """Seeded with the mean of the first n true ranges; 0 before."""
    df = wilder(df.withColumn("__tr", true_range()), {name: F.col("__tr")}, n, n - 1)
    return df.withColumn(name, F.coalesce(name, F.lit(0.0))).drop("__tr")


def _moves(df: DataFrame) -> DataFrame:
    """Rises of highs and falls of lows, each on its own, null in the first row."""
    return df.withColumn("__tr", true_range()).withColumn("__up", F.when(F.col("i") > 0, F.greatest(change(high()), F.lit(0.0)))).withColumn("__down", F.when(F.col("i") > 0, F.greatest(-change(low()), F.lit(0.0))))


def adx_simple(df: DataFrame, n: int = 14) -> DataFrame:
    """adx_14 of plain sums and means, with a pad of 1e-6 in the index."""
    df = _moves(df)
    df = df.withColumn("__t", rolling_sum(F.col("__tr"), n))
    df = df.withColumn("plus_di", 100 * ratio(rolling_sum(F.col("__up"), n), F.col("__t"))).withColumn("minus_di", 100 * ratio(rolling_sum(F.col("__down"), n), F.col("__t")))
    df = df.withColumn("__dx", 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / (F.col("plus_di") + F.col("minus_di") + 1e-6))
    return df.withColumn("adx_14", rolling_mean(F.col("__dx"), n)).drop("__tr", "__up", "__down", "__t", "__dx")


def adx_wilder(df: DataFrame, n: int = 14, name: str = "adx_wilder") -> DataFrame:
    """Wilder's index: only the larger move counts; sums seeded over rows 1 to n, the mean of n indices after that; a zero range gives index 0."""
    df = df.withColumn("__tr", true_range()).withColumn("__rise", change(high())).withColumn("__fall", -change(low()))
    df = df.withColumn("__up", F.when((F.col("__rise") > F.col("__fall")) & (F.col("__rise") > 0), F.col("__rise")).otherwise(0.0))
    df = df.withColumn("__down", F.when((F.col("__fall") > F.col("__rise")) & (F.col("__fall") > 0), F.col("__fall")).otherwise(0.0))
    df = wilder(df, {"__st": F.col("__tr"), "__su": F.col("__up"), "__sd": F.col("__down")}, n, n, total=True)
    both = F.col("__su") + F.col("__sd")
    df = df.withColumn("__dx", F.when(both > 0, 100 * F.abs(F.col("__su") - F.col("__sd")) / F.nullif(both, F.lit(0.0))).otherwise(F.when(F.col("__st").isNotNull(), F.lit(0.0))))
    df = wilder(df, {name: F.col("__dx")}, n, 2 * n - 1)
    return df.drop("__tr", "__rise", "__fall", "__up", "__down", "__st", "__su", "__sd", "__dx")


def macd(df: DataFrame, config: Config = DEFAULT, warm: bool = False) -> DataFrame:
    """macd, macd_signal, macd_diff; with *warm* null until the spans are filled."""
    fast, slow, signal = config.macd
    df = ewm(df, {"__f": (close(), 2 / (fast + 1)), "__s": (close(), 2 / (slow + 1))})
    if not warm:
        df = ewm(df.withColumn("macd", F.col("__f") - F.col("__s")), {"macd_signal": (F.col("macd"), 2 / (signal + 1))})
    else:
        df = df.withColumn("macd", F.when(F.col("i") >= slow - 1, F.col("__f") - F.col("__s")))
        df = ewm_from(df, "macd_signal", F.col("macd"), 2 / (signal + 1), slow - 1)
        df = df.withColumn("macd_signal", F.when(F.col("i") >= slow + signal - 2, F.col("macd_signal")))
    return df.withColumn("macd_diff", F.col("macd") - F.col("macd_signal")).drop("__f", "__s")


def macd_events(df: DataFrame) -> DataFrame:
    """crossover (line from below to above its signal), hist_improving (last three differences rising), hist_last3."""
    line, signal, diff = F.col("macd"), F.col("macd_signal"), F.col("macd_diff")
    crossed = F.coalesce((lag(line) < lag(signal)) & (line > signal), F.lit(False))
    rising = F.coalesce((diff > lag(diff)) & (lag(diff) > lag(diff, 2)), F.lit(False))
    last3 = F.filter(F.array(lag(diff, 2), lag(diff), diff), lambda x: x.isNotNull())
    return df.withColumn("crossover", crossed).withColumn("hist_improving", rising).withColumn("hist_last3", last3)


def ema(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """ema20 and ema50, null until their windows are filled."""
    df = ewm(df, {f"ema{span}": (close(), 2 / (span + 1)) for span in config.ema})
    return df.withColumns({f"ema{span}": F.when(F.col("i") >= span - 1, F.col(f"ema{span}")) for span in config.ema})


def momentum(df: DataFrame) -> DataFrame:
    """returns_1, price_momentum (5 rows), volatility (sample deviation of 20 returns)."""
    df = df.withColumn("returns_1", ratio(close(), lag(close())) - 1).withColumn("price_momentum", ratio(close(), lag(close(), 5)) - 1)
    return df.withColumn("volatility", rolling_std(F.col("returns_1"), 20))


def volume_spike(df: DataFrame) -> DataFrame:
    """volume_spike (against its mean of 20, less 1) and volume_ratio (mean 0 or unknown: 1; two digits)."""
    mean = rolling_mean(volume(), 20)
    df = df.withColumn("volume_spike", ratio(volume(), mean) - 1)
    return df.withColumn("volume_ratio", F.when(F.coalesce(mean, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.round(volume() / F.greatest(mean, F.lit(1e-10)), 2)))


#: The gold feature set, in order.
GOLD_FEATURES = (
    "rsi_14", "macd", "macd_signal", "macd_diff", "adx_14", "atr_14", "bb_width", "bb_position", "close_above_bb_upper", "close_above_bb_lower",
    "close_above_ma20", "close_above_ma50", "price_momentum", "volatility", "volume_spike", "usd_strength", "real_rates_momentum", "risk_sentiment",
    "session_hour_encoded", "day_of_week_encoded",
)
#: The base feature set, in order.
BASE_FEATURES = (
    "rsi_14", "rsi_oversold", "rsi_overbought", "macd", "macd_signal", "macd_diff", "atr_14", "bb_width", "bb_position", "adx_14",
    "close_above_ma20", "close_above_ma50", "price_momentum", "returns_1", "volatility", "volume_ma20", "volume_spike",
)


def with_macro(df: DataFrame, macro: DataFrame | None) -> DataFrame:
    """usd_strength, real_rates_momentum, risk_sentiment: the newest macro row at or before ts, or 0, 0, 50.

    *macro* is (ts, usd_strength, real_rates_momentum, risk_sentiment), one row a
    time.  Candles meet the macro rows of their own day, and else the last row
    of the days before: only one row a day is carried from day to day.
    """
    names = {"usd_strength": 0.0, "real_rates_momentum": 0.0, "risk_sentiment": 50.0}
    if macro is None:
        return df.withColumns({c: F.lit(v) for c, v in names.items()})
    row = F.struct(*names)
    rows = macro.select(F.to_date("ts").alias("__day"), F.col("ts").alias("__from"), row.alias("__m"))
    spans = rows.withColumn("__until", F.lead("__from").over(Window.partitionBy("__day").orderBy("__from")))
    # the days are few thousand rows, so one task may order them
    last = rows.groupBy("__day").agg(F.max_by("__m", "__from").alias("__last"))
    days = df.select(F.to_date("ts").alias("__day")).distinct().join(last, "__day", "full")
    before = Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(F.col("__day").alias("__d"), F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    joined = df.withColumn("__d", F.to_date("ts")).join(carried, "__d", "left")
    joined = joined.join(spans, (F.col("__d") == F.col("__day")) & (F.col("ts") >= F.col("__from")) & (F.col("__until").isNull() | (F.col("ts") < F.col("__until"))), "left")
    held = F.coalesce("__m", "__carried")
    return joined.withColumns({c: F.coalesce(held[c], F.lit(v)) for c, v in names.items()}).drop("__d", "__day", "__from", "__until", "__m", "__carried")


def with_clock(df: DataFrame) -> DataFrame:
    """session_hour_encoded (hour / 24) and day_of_week_encoded (Monday 0, by 7) of the bar's time."""
    return df.withColumn("session_hour_encoded", F.hour("ts") / 24.0).withColumn("day_of_week_encoded", F.weekday("ts") / 7.0)


def gold_features(candles: DataFrame, macro: DataFrame | None = None) -> DataFrame:
    """Candles with the gold feature set (warm-up rows null)."""
    df = indexed(candles)
    for step in (rsi_simple, macd, atr_simple, adx_simple, moving_averages, momentum, volume_spike):
        df = step(df)
    return with_clock(with_macro(bollinger(df, pad=1e-6), macro))


def base_features(candles: DataFrame) -> DataFrame:
    """Candles with the base feature set (warm-up rows null)."""
    df = indexed(candles)
    df = rsi_wilder(df, name="rsi_14")
    df = df.withColumn("rsi_oversold", flag(F.col("rsi_14") < 35)).withColumn("rsi_overbought", flag(F.col("rsi_14") > 65))
    df = adx_wilder(atr_wilder(macd(df, warm=True), name="atr_14"), name="adx_14")
    for step in (moving_averages, momentum, volume_spike):
        df = step(df)
    return bollinger(df, population=True)


def filled(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The features back-filled, then 0: what a model is given."""
    return df.withColumns({c: fill_back(F.col(c).cast("double")) for c in names})


def drop_warmup(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Only rows with every feature known: no value from a later row."""
    return df.dropna(subset=list(names))
