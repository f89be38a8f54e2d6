"""Ticks, bars and candles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.config import DEFAULT, Config
from tickloom.functions.rolling import running_sum

SERIES = ("symbol", "tf")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, event_id, ts, price): a price walk per event type, and one of all events.

    A fixture of the registered queries, made from the events table; no part of
    the engine reads it.  Steps are whole ticks of 0.0001, so prices are exact.
    It is a running sum per symbol, ALL being one symbol of all events; a task
    holds some hours of a symbol.  Events are counted first, as more of them
    take more tasks.  Real ticks come with their prices.
    """
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "ts", "value")
    both = events.select(F.explode(F.array("event_type", F.lit("ALL"))).alias("symbol"), "event_id", "ts", "value")
    step = F.round(F.col("value") * 100).cast("long") - 5000
    hour = F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")
    walked = running_sum(both, "walk", step, ("symbol",), hour, ("ts", "event_id"), count=2 * events.count())
    return walked.select("symbol", "event_id", "ts", (F.lit(2400.0) + F.col("walk").cast("double") / 10000.0).alias("price"))


def bucket(ts: Column, minutes: Column | int) -> Column:
    """Start of the bar of *minutes* that holds ts, counted from the epoch (session time UTC); whole weeks from a Monday."""
    minutes = F.lit(minutes) if isinstance(minutes, int) else minutes
    at = F.unix_seconds(ts.cast("timestamp"))
    # the epoch was a Thursday
    past = F.pmod(at + F.when(minutes % 10080 == 0, 3 * 86400).otherwise(0), minutes * 60)
    return F.timestamp_seconds(at - past).cast("timestamp_ntz")


def bars(ticks_df: DataFrame, minutes: int, tf: str | None = None) -> DataFrame:
    """Candles (symbol, tf, ts, open, high, low, close, volume) of one length; ties by event_id."""
    order = F.struct("ts", "event_id")
    return (
        ticks_df.groupBy("symbol", bucket(F.col("ts"), minutes).alias("bar"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume"))
        .select("symbol", F.lit(tf or f"{minutes}m").alias("tf"), F.col("bar").alias("ts"), "open", "high", "low", "close", "volume")
    )


def ladder(ticks_df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Candles of every role: ticks are read once, longer bars are rolled up from the shortest ones."""
    step = min(m for _, m, _, _ in config.roles)
    base = bars(ticks_df, step)
    roles = F.array(*[F.struct(F.lit(t).alias("tf"), F.lit(m).alias("minutes")) for t, m, _, _ in config.roles])
    each = base.withColumn("role", F.explode(roles)).withColumn("bar", bucket(F.col("ts"), F.col("role.minutes")))
    return (
        each.groupBy("symbol", F.col("role.tf").alias("tf"), "bar")
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
        .select("symbol", "tf", F.col("bar").alias("ts"), "open", "high", "low", "close", "volume")
    )


def normalise_raw(raw: DataFrame) -> DataFrame:
    """Typed candles from string columns (symbol, tf, time, open, high, low, close, tickVolume).

    Rows whose time or a price does not parse are left out; a missing volume is 0.
    """
    price = {c: F.try_cast(F.col(c), "double") if hasattr(F, "try_cast") else F.col(c).try_cast("double") for c in ("open", "high", "low", "close")}
    typed = raw.select("symbol", "tf", F.try_to_timestamp(F.regexp_replace("time", "Z$", "+00:00")).cast("timestamp_ntz").alias("ts"), *[v.alias(c) for c, v in price.items()], F.coalesce(F.col("tickVolume").try_cast("double"), F.lit(0.0)).alias("volume"))
    return typed.dropna(subset=["ts", *price])


def drop_incomplete(candles: DataFrame, config: Config = DEFAULT, fetch: int | None = None, end: object = None) -> DataFrame:
    """The newest *fetch* bars of a series without its last one; series with too few bars go.

    With *end* (a time or a column) only bars that begin before it count: the
    scan as it was then.
    """
    if end is not None:
        candles = candles.where(F.col("ts") < (end if isinstance(end, Column) else F.lit(end).cast("timestamp_ntz")))
    fetch = config.fetch_bars if fetch is None else fetch
    newest = Window.partitionBy(*SERIES).orderBy(F.col("ts").desc())
    least = F.coalesce(F.create_map(*[x for t, _, _, m in config.roles for x in (F.lit(t), F.lit(m))])[F.col("tf")], F.lit(52))
    ranked = candles.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= fetch)
    ranked = ranked.withColumn("__n", F.count("*").over(Window.partitionBy(*SERIES)))
    return ranked.where((F.col("__rn") > 1) & (F.col("__n") >= least)).drop("__rn", "__n")


def scan_candles(spark: SparkSession, sf_dir: str, config: Config = DEFAULT, end: object = None) -> DataFrame:
    """What a scan reads: the ladder's newest complete bars, as of *end* if one is given."""
    return drop_incomplete(ladder(ticks(spark, sf_dir), config), config, end=end)


def fallback_15m(candles: DataFrame, last: int = 40) -> DataFrame:
    """Candles with a symbol's newest 1H bars standing in where it has no 15M bars."""
    has = candles.where(F.col("tf") == "15M").select("symbol").distinct()
    newest = Window.partitionBy("symbol").orderBy(F.col("ts").desc())
    stand_in = candles.where(F.col("tf") == "1H").join(has, "symbol", "left_anti").withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= last).drop("__rn").withColumn("tf", F.lit("15M"))
    return candles.unionByName(stand_in.select(*candles.columns))


def resolve_symbol(available: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(account, symbol): per account the first variant that has data, from (account, symbol, bars)."""
    place = F.create_map(*[x for k, v in enumerate(config.symbol_variants) for x in (F.lit(v), F.lit(k))])
    return available.where((F.col("bars") > 0) & F.col("symbol").isin(*config.symbol_variants)).groupBy("account").agg(F.min_by("symbol", F.element_at(place, F.col("symbol"))).alias("symbol"))


def since(candles: DataFrame, start: object) -> DataFrame:
    """Candles from *start* (a time or a column) on."""
    return candles.where(F.col("ts") >= (start if isinstance(start, Column) else F.lit(start).cast("timestamp_ntz")))


def synthetic_candles(spark: SparkSession, bars: int = 100, seed: int = 42, symbol: str = "SYNTHETIC", low: float = 2350.0, high: float = 2450.0) -> DataFrame:
    """Hourly candles of uniform prices and volumes (1,000 to 5,000), to try feature sets on; high and low bound the others only by chance."""
    price = [(F.lit(low) + F.rand(seed + k) * (high - low)).alias(c) for k, c in enumerate(("open", "high", "low", "close"))]
    start = F.lit("2025-01-01").cast("timestamp_ntz")
    return spark.range(bars).select(F.lit(symbol).alias("symbol"), F.lit("1H").alias("tf"), (start + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ts"), *price, (1000 + F.rand(seed + 4) * 4000).alias("volume"))


def last_price(candles: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(symbol, ts, price): newest close per symbol over all series; the shortest bar's on ties of time, by the roles' minutes (an unknown tf last)."""
    minutes = F.coalesce(F.create_map(*[x for t, m, _, _ in config.roles for x in (F.lit(t), F.lit(m))])[F.col("tf")], F.lit(1 << 30))
    return candles.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("close", F.struct("ts", -minutes, "tf")).alias("price"))
