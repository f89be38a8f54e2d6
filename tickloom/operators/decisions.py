"""Scores and decisions as column expressions and row-wise operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import DEFAULT, Config
from tickloom.operators.sessions import lookup


def _on(condition: Column, points: int) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), points).otherwise(0)


def confluence_skip(s: dict[str, Column]) -> Column:
    """No direction: the 4H structure ranges and neither 1W nor 1D has one."""
    sided = lambda c: F.coalesce(c.isin("bullish", "bearish"), F.lit(False))
    return F.coalesce(s["struct_4h"] == "ranging", F.lit(False)) & ~sided(s["struct_1w"]) & ~sided(s["struct_1d"])


def confluence_score(s: dict[str, Column]) -> Column:
    """Points, at most 100, from structures, events and momentum; 0 where skipped."""
    total = (
        F.when(F.coalesce(s["struct_4h"] == "bullish", F.lit(False)), 20).otherwise(10)
        + _on(s["struct_1d"] == "bullish", 15)
        + _on(s["struct_1w"] == "bullish", 10)
        + _on(s["broke_4h"], 15)
        + F.when(F.coalesce(s["at_block"], F.lit(False)), 20).when(F.coalesce(s["gap_1h"], F.lit(False)), 10).otherwise(0)
        + _on(s["sweep_1h"], 10)
        + _on(s["broke_15m"], 10)
        + _on(s["adx_15m"] > 20, 5)
        + _on(s["rsi_15m"] > 50, 5)
        + _on(s["in_killzone"], 5)
    )
    return F.when(confluence_skip(s), 0).otherwise(F.least(total, F.lit(100)))


def rounded(x: Column, digits: int) -> Column:
    """x with so many digits, halves away from 0."""
    return F.round(x * 10.0**digits) / 10.0**digits


def signal_levels(df: DataFrame, config: Config = DEFAULT, side_aware: bool = False) -> DataFrame:
    """Add stop_loss, sl_source, take_profit, rr_ratio, sl_pct, tp_pct, entry_low, entry_high.

    From price, atr, tp_level and the 15M and 4H (or 1H) blocks' low and
    mitigated.  Levels are built for a long trade, as rules of the score are;
    with *side_aware* a row of direction SELL gets them mirrored about the price.
    Computed prices and percentages have four digits, the ratio two; a target
    taken from a swing is that price.
    """
    n4 = lambda c: rounded(c, 4)
    use15 = F.coalesce(~F.col("ob15_mitigated"), F.lit(False))
    use4 = F.coalesce(~F.col("ob4_mitigated"), F.lit(False))
    df = df.withColumn("sl_source", F.when(use15, "15M_OB").when(use4, "4H_OB").otherwise("ATR"))
    df = df.withColumn("stop_loss", n4(F.when(use15, F.col("ob15_low") * (1 - 0.0005)).when(use4, F.col("ob4_low") * (1 - 0.0005)).otherwise(F.col("price") - F.col("atr") * config.atr_stop)))
    df = df.withColumn("take_profit", F.coalesce("tp_level", n4(F.col("price") + F.col("atr") * config.atr_target)))
    if side_aware:
        short = F.col("direction") == "SELL"
        for c in ("stop_loss", "take_profit"):
            df = df.withColumn(c, F.when(short, 2 * F.col("price") - F.col(c)).otherwise(F.col(c)))
    sign = F.when(F.col("direction") == "SELL", -1.0).otherwise(1.0) if side_aware else F.lit(1.0)
    risk, gain = sign * (F.col("price") - F.col("stop_loss")), sign * (F.col("take_profit") - F.col("price"))
    priced = F.col("price") > 0
    return (
        df.withColumn("rr_ratio", F.when(risk > 0, rounded(gain / F.nullif(risk, F.lit(0.0)), 2)).otherwise(0.0))
        .withColumn("sl_pct", F.when(priced, n4(risk / F.nullif("price", F.lit(0.0)) * 100)).otherwise(0.0))
        .withColumn("tp_pct", F.when(priced, n4(gain / F.nullif("price", F.lit(0.0)) * 100)).otherwise(0.0))
        .withColumn("entry_low", n4(F.col("price") * 0.9995))
        .withColumn("entry_high", n4(F.col("price") * 1.0005))
    )


def known_or(value: Column, price: Column) -> Column:
    """*value*, or the price where it is unknown or 0."""
    return F.coalesce(F.nullif(value, F.lit(0.0)), price)


def direction(struct_4h: Column) -> Column:
    return F.when(struct_4h == "bullish", "BUY").otherwise("SELL")


def direct_decision(scanned: DataFrame) -> DataFrame:
    """The signals of a scan (``scan.mtf_scan``) as trades, for when there is no analyst: (symbol, direction, entry, stop_loss, take_profit, score, message).

    What the scan has fired is taken as it is; nothing is taken while the market is closed.
    """
    side = direction(F.col("struct_4h"))
    shown = lambda c: F.coalesce(F.format_number(c, 4), F.lit("N/A"))
    text = F.concat_ws(
        "\n", F.concat(side, F.lit(" "), F.col("symbol"), F.lit(" taken on its score alone, without an analyst")), F.concat(F.lit("Entry "), shown("price"), F.lit(", stop "), shown("stop_loss"), F.lit(", target "), shown("take_profit")),
        F.concat(F.lit("Score "), F.col("score").cast("string"), F.lit("%")),
    )
    return scanned.where(F.coalesce(F.col("fired"), F.lit(False)) & (F.col("tier") != "closed")).select("symbol", side.alias("direction"), F.col("price").alias("entry"), "stop_loss", "take_profit", "score", text.alias("message"))


def filter_decision(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """From smc_score, ml_confidence (50 where unknown) and tier: combined, threshold, should_trade, reason."""
    a, b = config.weights_filter
    df = df.withColumn("ml_confidence", F.coalesce("ml_confidence", F.lit(50.0)))
    df = df.withColumn("combined", F.col("smc_score") * a + F.col("ml_confidence") * b).withColumn("threshold", lookup(config.thresholds_filter, F.col("tier"), 70))
    df = df.withColumn("should_trade", F.col("combined") >= F.col("threshold"))
    whole = lambda c: F.format_string("%.0f", c)
    told = lambda word, far: F.concat(F.lit(f"{word}: "), whole(F.col("combined")), F.lit(" of "), F.col("threshold").cast("string"), F.lit(" needed, "), whole(far), F.lit(" apart; the model gives "), whole(F.col("ml_confidence")))
    below, above = told("rejected", F.col("threshold") - F.col("combined")), told("accepted", F.col("combined") - F.col("threshold"))
    return df.withColumn("reason", F.when(F.col("should_trade"), above).otherwise(below))


def composite_decision(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """From ml_confidence, analyst_confidence (50 where unknown), smc_score and tier: combined, threshold, should_trade, reason."""
    a, b, c = config.weights_composite
    df = df.withColumn("ml_confidence", F.coalesce("ml_confidence", F.lit(50.0))).withColumn("analyst_confidence", F.coalesce("analyst_confidence", F.lit(50.0)))
    df = df.withColumn("combined", F.col("ml_confidence") * a + F.col("analyst_confidence") * b + F.col("smc_score") * c)
    df = df.withColumn("threshold", lookup(config.thresholds_composite, F.col("tier"), 52)).withColumn("should_trade", F.col("combined") >= F.col("threshold"))
    text = F.format_string("model %.0f, analyst %.0f and structure %.0f make %.0f of ", "ml_confidence", "analyst_confidence", F.col("smc_score").cast("double"), "combined")
    return df.withColumn("reason", F.concat(F.when(F.col("should_trade"), "accepted: ").otherwise("rejected: "), text, F.col("threshold").cast("string"), F.lit(" needed")))


def parse_analyst(df: DataFrame, text: str = "response") -> DataFrame:
    """Add parsed, should_trade, analyst_confidence (at least 40), reasoning from a reply that holds a JSON object."""
    body = F.nullif(F.regexp_extract(F.col(text), r"(?s)\{.*\}", 0), F.lit(""))
    df = df.withColumn("__j", F.from_json(body, "should_trade boolean, confidence double, reasoning string, __bad string", {"columnNameOfCorruptRecord": "__bad"}))
    ok = F.col("__j").isNotNull() & F.col("__j.__bad").isNull()
    df = df.withColumn("parsed", F.coalesce(ok, F.lit(False)))
    return (
        df.withColumn("should_trade", F.when(F.col("parsed"), F.coalesce("__j.should_trade", F.lit(True))).otherwise(True))
        .withColumn("analyst_confidence", F.when(F.col("parsed"), F.greatest(F.coalesce("__j.confidence", F.lit(50.0)), F.lit(40.0))).otherwise(50.0))
        .withColumn("reasoning", F.when(F.col("parsed"), F.coalesce("__j.reasoning", F.lit("no reason given"))).otherwise("reply without a readable object"))
        .drop("__j")
    )


def analyst_prompt(df: DataFrame, positions: DataFrame | None = None) -> DataFrame:
    """Add prompt: the signal with its levels, the model's confidence, the market's state and up to three open positions of its symbol.

    Columns that are absent or null are told as unknown: stop_loss, take_profit,
    ml_confidence, struct_4h, struct_1h, rsi_1h, atr, volatility, news_block.
    """
    if positions is not None:
        first = Window.partitionBy("symbol").orderBy("signal_id")
        lines = positions.withColumn("__rn", F.row_number().over(first)).where("__rn <= 3").groupBy("symbol").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rn", F.format_string("%s %s from %s, result %s", "direction", "symbol", F.col("entry_price").cast("string"), F.col("pnl").cast("string")).alias("t")))), lambda x: x["t"]), "\n").alias("__open"))
        df = df.join(lines, "symbol", "left")
    else:
        df = df.withColumn("__open", F.lit(None).cast("string"))
    have = set(df.columns)
    shown = lambda c, digits=None: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(f"%.{digits}f", F.col(c).cast("double"))) if digits is not None else F.col(c).cast("string"), F.lit("unknown")) if c in have else F.lit("unknown")
    parts = [
        (F.lit("Signal: "), F.col("direction"), F.lit(" "), F.col("symbol"), F.lit(", score "), shown("smc_score", 0), F.lit(" of 100, price "), shown("price", 4)),
        (F.lit("Levels: stop "), shown("stop_loss", 4), F.lit(", target "), shown("take_profit", 4)),
        (F.lit("Model: "), shown("ml_confidence", 0), F.lit(" of 100")),
        (F.lit("Market: 4H "), shown("struct_4h"), F.lit(", 1H "), shown("struct_1h"), F.lit(", RSI "), shown("rsi_1h", 1), F.lit(", ATR "), shown("atr", 4), F.lit(", volatility "), shown("volatility", 4), F.lit(", news "), shown("news_block")),
        (F.lit("Open positions:"),),
        (F.coalesce("__open", F.lit("none")),),
        (F.lit("Reply with one JSON object: should_trade, confidence from 0 to 100, reasoning."),),
    ]
    return df.withColumn("prompt", F.concat_ws("\n", *[F.concat(*p) for p in parts])).drop("__open")


def macro_buckets(df: DataFrame) -> DataFrame:
    """Add usd_trend, rate_direction, risk_sentiment, risk_mode from usd_momentum, rate_momentum, vix."""
    usd = F.when(F.col("usd_momentum") > 0.5, "strong_up").when(F.col("usd_momentum") > 0.1, "weak").otherwise("strong_down")
    rate = F.when(F.col("rate_momentum") > 0.1, "rising").when(F.col("rate_momentum") > -0.1, "stable").otherwise("falling")
    mode = F.when(F.col("vix") < 12, "risk_on").when(F.col("vix") < 18, "neutral").otherwise("risk_off")
    return df.withColumn("usd_trend", usd).withColumn("rate_direction", rate).withColumn("risk_sentiment", F.least(F.greatest(F.col("vix") * 5, F.lit(0.0)), F.lit(100.0))).withColumn("risk_mode", mode)


def macro_validate(df: DataFrame) -> DataFrame:
    """Add usd_supports, rates_support, equity_supports, smt_score, is_blocked, is_confirmed, reasoning for direction BUY or SELL."""
    buy, usd, rate, mode = F.col("direction") == "BUY", F.col("usd_trend"), F.col("rate_direction"), F.col("risk_mode")
    df = df.withColumn("usd_supports", F.when(buy, usd != "strong_up").otherwise(usd == "strong_up"))
    df = df.withColumn("rates_support", F.when(buy, rate == "falling").otherwise(rate == "rising"))
    df = df.withColumn("equity_supports", F.when(buy, mode == "risk_off").otherwise(mode == "risk_on"))
    df = df.withColumn("smt_score", F.lit(50) + sum(_on(F.col(c), 15) for c in ("usd_supports", "rates_support", "equity_supports")))
    stop_buy = buy & (usd == "strong_up") & (rate == "rising")
    stop_sell = (F.col("direction") == "SELL") & (usd == "strong_down") & (rate == "falling")
    df = df.withColumn("is_blocked", stop_buy | stop_sell).withColumn("is_confirmed", (F.col("smt_score") >= 60) & ~F.col("is_blocked"))
    part = lambda c, label, v: F.concat(F.lit(label), v, F.when(F.col(c), " for").otherwise(" against"))
    text = F.concat_ws(", ", F.concat(F.lit("cross-market score "), F.col("smt_score").cast("string")), part("usd_supports", "dollar ", usd), part("rates_support", "rates ", rate), part("equity_supports", "equities ", mode))
    return df.withColumn("reasoning", F.when(stop_buy, "blocked: no buying into a rising dollar and rising rates").when(stop_sell, "blocked: no selling into a falling dollar and falling rates").otherwise(text))


def split_targets(df: DataFrame, shares: tuple[float, ...] = DEFAULT.target_shares) -> DataFrame:
    """A row per partial target between price and take_profit: target_no, share, target_price."""
    parts = F.array(*[F.struct(F.lit(k + 1).alias("no"), F.lit(s).alias("s")) for k, s in enumerate(shares)])
    return df.withColumn("__p", F.explode(parts)).withColumn("target_no", F.col("__p.no")).withColumn("share", F.col("__p.s")).withColumn("target_price", F.col("price") + (F.col("take_profit") - F.col("price")) * F.col("__p.s")).drop("__p")
