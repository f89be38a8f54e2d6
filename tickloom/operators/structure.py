"""Price structure: pivots, breaks, sweeps, order blocks, gaps and zones, per (symbol, tf).

Each operator takes indexed candles (``functions.rolling.indexed``: place i,
length n) and returns one row per series that has the pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import DEFAULT, Config
from tickloom.functions.rolling import SERIES, lag, series
from tickloom.operators.long_series import first_close_above

KEYS = list(SERIES)
#: Bars of a block of a first-match join: with n bars a level meets n / FIRST_BLOCK blocks and two blocks' bars.
FIRST_BLOCK = 512


def swings(candles: DataFrame, config: Config = DEFAULT, neighbours: int | None = None) -> DataFrame:
    """Add swing_high and swing_low: strictly beyond the N rows on either side, N by the role of tf (else 3)."""
    roles = {t: n for t, _, n, _ in config.roles} if neighbours is None else {}
    default = 3 if neighbours is None else neighbours
    high = low = F.lit(False)
    for n in sorted({default, *roles.values()}):
        before, after = series().rowsBetween(-n, -1), series().rowsBetween(1, n)
        inside = (F.col("i") >= n) & (F.col("i") < F.col("n") - n)
        mine = F.coalesce(F.col("tf").isin(*[t for t, k in roles.items() if k == n]), F.lit(False)) if n in roles.values() else F.lit(False)
        if n == default:
            mine = mine | ~F.coalesce(F.col("tf").isin(*roles), F.lit(False))
        high = high | (mine & inside & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after)))
        low = low | (mine & inside & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after)))
    return candles.withColumn("swing_high", F.coalesce(high, F.lit(False))).withColumn("swing_low", F.coalesce(low, F.lit(False)))


def pivots(swung: DataFrame) -> DataFrame:
    """Per series: number of swing highs and lows, and places and prices of the last two of each (newest first)."""
    newest = Window.partitionBy(*KEYS).orderBy(F.col("i").desc())
    hn = F.sum(F.col("swing_high").cast("int")).over(newest)
    ln = F.sum(F.col("swing_low").cast("int")).over(newest)
    ranked = swung.withColumn("__h", F.when(F.col("swing_high"), hn)).withColumn("__l", F.when(F.col("swing_low"), ln))
    pick = lambda c, k, v: F.max(F.when(F.col(c) == k, F.col(v)))
    return ranked.groupBy(*KEYS).agg(
        F.count("__h").alias("n_highs"), F.count("__l").alias("n_lows"),
        pick("__h", 1, "high").alias("h2"), pick("__h", 2, "high").alias("h1"), pick("__l", 1, "low").alias("l2"), pick("__l", 2, "low").alias("l1"),
        pick("__h", 1, "i").alias("h2_i"), pick("__l", 1, "i").alias("l2_i"), F.max_by("close", "i").alias("last_close"), F.max("n").alias("n"),
    )


def market_structure(swung: DataFrame) -> DataFrame:
    """(.., structure): bullish if both last pivots rose, bearish if both fell, else ranging."""
    up = (F.col("h2") > F.col("h1")) & (F.col("l2") > F.col("l1"))
    down = (F.col("h2") < F.col("h1")) & (F.col("l2") < F.col("l1"))
    known = (F.col("n_highs") >= 2) & (F.col("n_lows") >= 2)
    return pivots(swung).select(*KEYS, "n_highs", "n_lows", F.when(known & up, "bullish").when(known & down, "bearish").otherwise("ranging").alias("structure"))


def _first_close_above(levels: DataFrame, candles: DataFrame, carry: list[str]) -> DataFrame:
    """Per level (series, from_i, level): the first later place j whose close is above it.

    A series is cut in blocks of FIRST_BLOCK bars.  A level meets the blocks'
    greatest closes to find the first later block that reaches it, and then the
    bars of that block and of its own only.
    """
    cut = lambda c: F.floor(F.col(c) / F.lit(FIRST_BLOCK)).cast("long")
    bars = candles.select(*KEYS, F.col("i").alias("j"), "close", cut("i").alias("__b"))
    tops = bars.groupBy(*KEYS, "__b").agg(F.max("close").alias("__top"))
    names = [*KEYS, "from_i", "level", *carry]
    levels = levels.select(*names)
    next_ = levels.join(tops, KEYS).where((F.col("__b") > cut("from_i")) & (F.col("__top") > F.col("level"))).groupBy(*names).agg(F.min("__b").alias("__b"))
    each = levels.withColumn("__b", cut("from_i")).unionByName(next_)
    hits = each.join(bars, [*KEYS, "__b"]).where((F.col("j") > F.col("from_i")) & (F.col("close") > F.col("level")))
    return hits.groupBy(*names).agg(F.min("j").alias("j"))


def bos_up(swung: DataFrame, depth: int | None = None) -> DataFrame:
    """(.., bos_index, broken_level, swing_high_index): the newest first close above a swing high; needs two highs, ties go to the oldest swing.

    For long series *depth* is that of ``long_series.first_close_above``.
    """
    highs = swung.where("swing_high").select(*KEYS, F.col("i").alias("from_i"), F.col("high").alias("level"))
    two = highs.groupBy(*KEYS).agg(F.count("*").alias("k")).where("k >= 2").select(*KEYS)
    levels = highs.join(two, KEYS, "left_semi")
    hits = _first_close_above(levels, swung, []) if depth is None else first_close_above(levels, swung, depth)
    best = hits.groupBy(*KEYS).agg(F.max_by(F.struct("j", "level", "from_i"), F.struct("j", -F.col("from_i"))).alias("m"))
    return best.select(*KEYS, F.col("m.j").alias("bos_index"), F.col("m.level").alias("broken_level"), F.col("m.from_i").alias("swing_high_index"))


def choch_up(swung: DataFrame) -> DataFrame:
    """(.., choch_index, broken_level, swing_low_index): after the last swing low, the first close above the last swing high before it."""
    low = Window.partitionBy(*KEYS)
    marked = swung.withColumn("__sl", F.max(F.when(F.col("swing_low"), F.col("i"))).over(low))
    prior = marked.where("swing_high and i < __sl").groupBy(*KEYS, "__sl").agg(F.max_by("high", "i").alias("level"))
    hits = _first_close_above(prior.select(*KEYS, F.col("__sl").alias("from_i"), "level"), swung, [])
    return hits.select(*KEYS, F.col("j").alias("choch_index"), F.col("level").alias("broken_level"), F.col("from_i").alias("swing_low_index"))


def liquidity_sweep(swung: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(.., sweep_index, swept_level, wick_low, close_after, age): newest swing low but the last one, then its first later bar among the last 20 that dips below and closes above."""
    newest = Window.partitionBy(*KEYS)
    lows = swung.where("swing_low").withColumn("__last", F.max("i").over(newest)).where("i < __last").select(*KEYS, F.col("i").alias("sl"), F.col("low").alias("level"))
    later = swung.select(*KEYS, F.col("i").alias("j"), "low", "close", "n").where(F.col("j") >= F.col("n") - config.sweep_lookback)
    hits = lows.join(later, KEYS).where("j > sl and low < level and close > level")
    best = hits.groupBy(*KEYS).agg(F.max_by(F.struct("j", "level", "low", "close", "n"), F.struct("sl", -F.col("j"))).alias("m"))
    return best.select(*KEYS, F.col("m.j").alias("sweep_index"), F.col("m.level").alias("swept_level"), F.col("m.low").alias("wick_low"), F.col("m.close").alias("close_after"), (F.col("m.n") - F.col("m.j")).alias("age"))


def order_block(swung: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(.., ob_index, ob_open, ob_high, ob_low, ob_close, mitigated): last falling bar in the 20 before the break; mitigated by a later close below it."""
    broken = bos_up(swung).select(*KEYS, "bos_index")
    rows = swung.select(*KEYS, "i", "open", "high", "low", "close").join(broken, KEYS)
    block = rows.where((F.col("i") >= F.col("bos_index") - config.block_lookback) & (F.col("i") < F.col("bos_index")) & (F.col("close") < F.col("open"))).groupBy(*KEYS).agg(F.max_by(F.struct("i", "open", "high", "low", "close"), "i").alias("b"))
    after = rows.where("i >= bos_index").groupBy(*KEYS).agg(F.min("close").alias("least"))
    return block.join(after, KEYS).select(*KEYS, F.col("b.i").alias("ob_index"), *[F.col(f"b.{c}").alias(f"ob_{c}") for c in ("open", "high", "low", "close")], (F.col("least") < F.col("b.low")).alias("mitigated"))


def at_block(price, high, low, mitigated, config: Config = DEFAULT):
    """Whether a price stands in an unmitigated block, with tolerance; false without a block."""
    tol = high * config.block_tolerance
    return F.coalesce(~mitigated & price.between(low - tol, high + tol), F.lit(False))


def fvg_up(candles: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(.., fvg_index, fvg_low, fvg_high, fvg_size_pct, age): newest unfilled gap between the bars around a strong rising bar; its edges have four digits, its size three."""
    body, span = lag(F.col("close")) - lag(F.col("open")), lag(F.col("high")) - lag(F.col("low"))
    floor = lag(F.col("high"), 2)
    df = candles.withColumn("__body", body).withColumn("__span", span).withColumn("fvg_low", floor).withColumn("__least", F.min("low").over(series().rowsBetween(0, Window.unboundedFollowing)))
    size = (F.col("low") - F.col("fvg_low")) / F.nullif("fvg_low", F.lit(0.0))
    ok = (
        (F.col("i") > F.greatest(F.lit(2), F.col("n") - config.gap_age)) & (F.col("__body") > 0) & (F.col("__span") != 0) & (F.col("__body") / F.nullif("__span", F.lit(0.0)) >= 0.6)
        & (F.col("low") > F.col("fvg_low")) & (size >= config.gap_least) & (F.col("__least") >= F.col("fvg_low"))
    )
    best = df.where(ok).groupBy(*KEYS).agg(F.max_by(F.struct("i", "fvg_low", "low", size.alias("size"), "n"), "i").alias("m"))
    return best.select(*KEYS, (F.col("m.i") - 1).alias("fvg_index"), F.round("m.fvg_low", 4).alias("fvg_low"), F.round("m.low", 4).alias("fvg_high"), F.round(F.col("m.size") * 100, 3).alias("fvg_size_pct"), (F.col("m.n") - F.col("m.i")).alias("age"))


def premium_discount(swung: DataFrame) -> DataFrame:
    """(.., zone, pct_in_range, range_high, range_low): where the last close stands between the last swing high and low."""
    p = pivots(swung).withColumn("__r", F.col("h2") - F.col("l2"))
    known = F.coalesce(F.col("__r") > 0, F.lit(False))
    p = p.withColumn("pct_in_range", F.when(known, (F.col("last_close") - F.col("l2")) / F.nullif("__r", F.lit(0.0))).otherwise(0.5))
    both = (F.col("n_highs") > 0) & (F.col("n_lows") > 0)
    zone = F.when(~known, "unknown").when(F.col("pct_in_range") <= 0.40, "discount").when(F.col("pct_in_range") >= 0.60, "premium").otherwise("equilibrium")
    return p.select(*KEYS, zone.alias("zone"), "pct_in_range", F.when(both, F.col("h2")).alias("range_high"), F.when(both, F.col("l2")).alias("range_low"))


def nearest_target(swung: DataFrame, prices: DataFrame | None = None, tf: str | None = None) -> DataFrame:
    """(.., price, tp_level): least swing high above price * 1.001, to four digits; *prices* is (symbol, price), else the last close."""
    if tf is not None:
        swung = swung.where(F.col("tf") == tf)
    if prices is None:
        prices_by = swung.groupBy(*KEYS).agg(F.max_by("close", "i").alias("price"))
        rows = swung.join(prices_by, KEYS)
    else:
        rows = swung.join(prices, "symbol")
    return rows.groupBy(*KEYS, "price").agg(F.round(F.min(F.when(F.col("swing_high") & (F.col("high") > F.col("price") * 1.001), F.col("high"))), 4).alias("tp_level"))


def structure_history(swung: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Candles with the structure as known at each bar: a swing counts from N bars after it, when it is confirmed."""
    roles = F.coalesce(F.create_map(*[x for t, _, n, _ in config.roles for x in (F.lit(t), F.lit(n))])[F.col("tf")], F.lit(3))
    df = swung
    for flag, price, a, b in (("swing_high", "high", "h1", "h2"), ("swing_low", "low", "l1", "l2")):
        confirmed = F.lit(None).cast("double")
        for n in sorted({n for _, _, n, _ in config.roles} | {3}):
            confirmed = F.when(roles == n, F.when(lag(F.col(flag), n), lag(F.col(price), n))).otherwise(confirmed)
        df = df.withColumn("__c", confirmed)
        upto = series().rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn(b, F.last("__c", ignorenulls=True).over(upto))
        earlier = F.last("__c", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1))
        df = df.withColumn("__p", F.when(F.col("__c").isNotNull(), earlier)).withColumn(a, F.last("__p", ignorenulls=True).over(upto)).drop("__c", "__p")
    up = (F.col("h2") > F.col("h1")) & (F.col("l2") > F.col("l1"))
    down = (F.col("h2") < F.col("h1")) & (F.col("l2") < F.col("l1"))
    return df.withColumn("structure", F.when(up, "bullish").when(down, "bearish").otherwise("ranging"))
