"""The multi-timeframe scan: one plan from candles to scored signals, a row per symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.config import DEFAULT, Config
from tickloom.functions.rolling import indexed
from tickloom.operators import decisions, indicators, sessions, structure


def series_facts(swung: DataFrame, config: Config = DEFAULT, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per series with its structure, events, blocks and zone, and the newest value of *carry*.

    A scan's series has at most ``config.fetch_bars`` rows, so each fits in one
    array and every pattern is an expression over it: the windows before and the
    grouping share one partitioning by series, without a join.  Patterns are
    those of ``operators.structure``, which has no bound on the length.
    """
    bar = F.struct("i", "open", "high", "low", "close", "swing_high", "swing_low")
    df = swung.groupBy(*structure.KEYS).agg(F.array_sort(F.collect_list(bar)).alias("b"), *[F.max_by(c, "i").alias(c) for c in carry])
    b = F.col("b")
    first = lambda x: F.try_element_at(x, F.lit(1))
    last = lambda x: F.try_element_at(x, F.lit(-1))
    df = df.select("*", F.size(b).cast("long").alias("n"), F.filter(b, lambda x: x["swing_high"]).alias("tops"), F.filter(b, lambda x: x["swing_low"]).alias("lows"))
    tops, lows, n = F.col("tops"), F.col("lows"), F.col("n")

    broken = F.transform(tops, lambda s: F.struct(first(F.filter(b, lambda x: (x["i"] > s["i"]) & (x["close"] > s["high"])))["i"].alias("j"), (-s["i"]).alias("m")))
    swept = F.flatten(F.transform(
        F.filter(lows, lambda s: s["i"] < F.col("low2")["i"]),
        lambda s: F.transform(F.filter(b, lambda x: (x["i"] > s["i"]) & (x["i"] >= n - config.sweep_lookback) & (x["low"] < s["low"]) & (x["close"] > s["low"])), lambda x: F.struct(s["i"].alias("s"), (-x["i"]).alias("j"))),
    ))

    def gap(x):
        one, two = F.try_element_at(b, x["i"].cast("int")), F.try_element_at(b, x["i"].cast("int") - 1)
        body, span = one["close"] - one["open"], one["high"] - one["low"]
        solid = (body > 0) & (span != 0) & (body / F.nullif(span, F.lit(0.0)) >= 0.6)
        wide = (x["low"] > two["high"]) & ((x["low"] - two["high"]) / F.nullif(two["high"], F.lit(0.0)) >= config.gap_least)
        return (x["i"] > F.greatest(F.lit(2), n - config.gap_age)) & solid & wide & ~F.exists(b, lambda z: (z["i"] >= x["i"]) & (z["low"] < two["high"]))

    df = df.select("*", last(tops).alias("top2"), F.try_element_at(tops, F.lit(-2)).alias("top1"), last(lows).alias("low2"), F.try_element_at(lows, F.lit(-2)).alias("low1"), last(b)["close"].alias("last_close"))
    df = df.select("*", F.when(F.size(tops) >= 2, F.array_max(F.filter(broken, lambda x: x["j"].isNotNull()))["j"]).alias("bos_index"), last(F.filter(tops, lambda s: s["i"] < F.col("low2")["i"])).alias("prior"))
    span = F.col("top2")["high"] - F.col("low2")["low"]
    inside = F.coalesce(span > 0, F.lit(False))
    df = df.select(
        "*",
        first(F.filter(b, lambda x: (x["i"] > F.col("low2")["i"]) & (x["close"] > F.col("prior")["high"])))["i"].alias("choch_index"),
        (-F.array_max(swept)["j"]).alias("sweep_index"),
        last(F.filter(b, lambda x: (x["i"] >= F.col("bos_index") - config.block_lookback) & (x["i"] < F.col("bos_index")) & (x["close"] < x["open"]))).alias("block"),
        (last(F.filter(b, gap))["i"] - 1).alias("fvg_index"),
        F.when(inside, (F.col("last_close") - F.col("low2")["low"]) / F.nullif(span, F.lit(0.0))).otherwise(0.5).alias("pct_in_range"),
    )
    up = (F.col("top2")["high"] > F.col("top1")["high"]) & (F.col("low2")["low"] > F.col("low1")["low"])
    down = (F.col("top2")["high"] < F.col("top1")["high"]) & (F.col("low2")["low"] < F.col("low1")["low"])
    return df.select(
        *structure.KEYS, "n", "last_close", "bos_index", "choch_index", "sweep_index", "fvg_index", "pct_in_range", *carry,
        F.when(up, "bullish").when(down, "bearish").otherwise("ranging").alias("structure"),
        F.when(~inside, "unknown").when(F.col("pct_in_range") <= 0.40, "discount").when(F.col("pct_in_range") >= 0.60, "premium").otherwise("equilibrium").alias("zone"),
        F.col("block")["high"].alias("ob_high"), F.col("block")["low"].alias("ob_low"),
        F.when(F.col("block").isNotNull(), F.exists(b, lambda x: (x["i"] >= F.col("bos_index")) & (x["close"] < F.col("block")["low"]))).alias("mitigated"),
        F.transform(tops, lambda s: s["high"]).alias("top_highs"),
    )


def context(facts: DataFrame) -> DataFrame:
    """A row per symbol out of one row per series, by conditional aggregation over the roles."""
    of = lambda tf, c: F.max(F.when(F.col("tf") == tf, F.col(c)))
    return facts.groupBy("symbol").agg(
        *[of(t, "structure").alias(f"struct_{t.lower()}") for t in ("1W", "1D", "4H", "1H", "15M")],
        *[of(t, c).alias(f"{c}_{t.lower()}") for t in ("4H", "1H", "15M") for c in ("bos_index", "choch_index", "ob_high", "ob_low", "mitigated")],
        of("1H", "sweep_index").alias("sweep_index"), of("1H", "fvg_index").alias("fvg_index"), of("4H", "zone").alias("zone"), of("4H", "pct_in_range").alias("pct_in_range"),
        of("1H", "last_close").alias("price"), of("4H", "top_highs").alias("top_highs"), of("1H", "atr_wilder").alias("atr"), of("1H", "ts").alias("last_ts"),
        of("15M", "adx_wilder").alias("adx_15m"), of("15M", "rsi_wilder").alias("rsi_15m"),
    )


def mtf_scan(candles: DataFrame, config: Config = DEFAULT, side_aware: bool = False) -> DataFrame:
    """A row per symbol, fired or not: structures, events, score, decision gate and levels as of its newest 1H bar's end.

    Takes a scan's candles (``market.drop_incomplete``).  Two exchanges follow
    them: one by series for windows and patterns, one by symbol for the rest.
    """
    df = structure.swings(indexed(candles), config)
    df = indicators.rsi_wilder(indicators.adx_wilder(indicators.atr_wilder(df)))
    rows = context(series_facts(df, config, ("ts", "atr_wilder", "adx_wilder", "rsi_wilder"))).where("price is not null")
    rows = rows.withColumn("as_of", F.col("last_ts") + F.expr("interval 1 hour")).withColumn("tp_level", F.array_min(F.filter("top_highs", lambda h: h > F.col("price") * 1.001)))
    at = [structure.at_block(F.col("price"), F.col(f"ob_high_{t}"), F.col(f"ob_low_{t}"), F.col(f"mitigated_{t}"), config) for t in ("15m", "1h", "4h")]
    rows = rows.withColumn("at_block", at[0] | at[1] | at[2]).withColumn("killzone", sessions.killzone(F.col("as_of"), config))
    s = {
        "struct_4h": F.col("struct_4h"), "struct_1d": F.col("struct_1d"), "struct_1w": F.col("struct_1w"),
        "broke_4h": F.col("bos_index_4h").isNotNull() | F.col("choch_index_4h").isNotNull(), "broke_15m": F.col("bos_index_15m").isNotNull() | F.col("choch_index_15m").isNotNull(),
        "at_block": F.col("at_block"), "gap_1h": F.col("fvg_index").isNotNull(), "sweep_1h": F.col("sweep_index").isNotNull(),
        "adx_15m": F.col("adx_15m"), "rsi_15m": F.col("rsi_15m"), "in_killzone": F.col("killzone").isNotNull(),
    }
    rows = rows.withColumn("skipped", decisions.confluence_skip(s)).withColumn("score", decisions.confluence_score(s))
    has4 = F.col("ob_low_4h").isNotNull()
    rows = (
        rows.withColumn("ob15_low", F.col("ob_low_15m")).withColumn("ob15_mitigated", F.col("mitigated_15m"))
        .withColumn("ob4_low", F.when(has4, F.col("ob_low_4h")).otherwise(F.col("ob_low_1h"))).withColumn("ob4_mitigated", F.when(has4, F.col("mitigated_4h")).otherwise(F.col("mitigated_1h")))
        .withColumn("direction", decisions.direction(F.col("struct_4h")))
    )
    rows = decisions.signal_levels(rows, config, side_aware)
    guard = sessions.news_guard(F.col("as_of"), config)
    rows = rows.withColumn("news_block", guard).withColumn("tier", sessions.tier(F.col("as_of")))
    fired = ~F.col("skipped") & (F.col("score") >= config.min_score) & F.col("news_block").isNull() & (F.col("tier") != "closed")
    return rows.withColumn("fired", fired)


def display_record(candles: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A row per symbol of what messages and the analyst read beside the scan: the newest indicators of every role.

    Per role price, rsi, ema20, ema50, macd, signal, crossover and hist_last3
    (suffix 1w, 1d, 4h, 1h); averages that are unknown or 0 are the 1H price.
    Then volume_ratio of 1H, ema_status_1h and _4h, trend_up (weekly price above
    its slow average), ema_bullish and price_above_ema50 of 4H.
    """
    df = indicators.rsi_wilder(indexed(candles))
    df = indicators.volume_spike(indicators.ema(indicators.macd_events(indicators.macd(df, config, warm=True)), config))
    fast, slow = (f"ema{n}" for n in config.ema)
    names = {"close": "price", "rsi_wilder": "rsi", fast: "ema20", slow: "ema50", "macd": "macd", "macd_signal": "signal", "crossover": "crossover", "hist_last3": "hist_last3", "volume_ratio": "volume_ratio"}
    newest = df.groupBy(*structure.KEYS).agg(*[F.max_by(c, "i").alias(n) for c, n in names.items()])
    of = lambda tf, c: F.first(F.when(F.col("tf") == tf, F.col(c)), ignorenulls=True)
    rows = newest.groupBy("symbol").agg(
        *[of(tf, c).alias(f"{c}_{tf.lower()}") for tf in ("1W", "1D", "4H", "1H") for c in names.values() if c != "volume_ratio"], of("1H", "volume_ratio").alias("volume_ratio")
    ).where("price_1h is not null")
    rows = rows.withColumns({f"{c}_{t}": decisions.known_or(F.col(f"{c}_{t}"), F.col("price_1h")) for t in ("1w", "4h", "1h") for c in ("ema20", "ema50")})
    rows = rows.withColumns({f"ema_status_{t}": F.when(F.col(f"ema20_{t}") > F.col(f"ema50_{t}"), "EMA20>EMA50").otherwise("EMA20<EMA50") for t in ("1h", "4h")})
    rows = rows.withColumns({f"{c}_1h": F.coalesce(f"{c}_1h", F.lit(0.0)) for c in ("macd", "signal")} | {"crossover_1h": F.coalesce("crossover_1h", F.lit(False)), "volume_ratio": F.coalesce("volume_ratio", F.lit(1.0))})
    return rows.withColumns({"trend_up": F.col("price_1h") > F.col("ema50_1w"), "ema_bullish": F.col("ema20_4h") > F.col("ema50_4h"), "price_above_ema50": F.col("price_1h") > F.col("ema50_4h")})
