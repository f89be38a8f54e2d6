"""The engine's queries by name, each over whole tables, with SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.config import DEFAULT
from tickloom.functions import chunks, rolling
from tickloom.functions.rolling import indexed, q6
from tickloom.operators import admission, decisions, indicators, ledger, long_series, ml, reports, scan, sessions, structure
from tickloom.plans import sql
from tickloom.sources import broker, market
from tickloom.streaming import bars as streaming
from tickloom.streaming import late, ledger_table, resolver

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if oracle is not None:
            _SQL[f.__name__] = oracle
        return f

    return add


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed(market.bars(market.ticks(spark, sf_dir), 60, "1H"))


def _swung(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.swings(indexed(market.scan_candles(spark, sf_dir, sql.FIXTURE)))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.from_orders(market.table(spark, sf_dir, "orders"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision inputs made from events: scores, confidences and a time shifted over the calendars."""
    k = F.col("event_id")
    days = F.make_dt_interval(days=F.pmod(k * 7, F.lit(730)).cast("int"))
    return market.table(spark, sf_dir, "events").select(
        "event_id", (F.lit("2025-01-01").cast("timestamp_ntz") + days + (F.col("ts") - F.date_trunc("day", F.col("ts")).cast("timestamp_ntz"))).alias("ts"),
        F.pmod(k * 13, F.lit(101)).cast("double").alias("smc_score"), F.pmod(k * 29, F.lit(101)).cast("double").alias("ml_confidence"),
        F.when(k % 7 != 0, F.pmod(k * 31, F.lit(101)).cast("double")).alias("analyst_confidence"),
        F.element_at(F.array(F.lit("STRONG"), F.lit("MODERATE"), F.lit("WEAK"), F.lit("NONE")), (F.pmod(k, F.lit(4)) + 1).cast("int")).alias("quality"),
        ((F.pmod(k * 17, F.lit(21)) - 10) / 10.0).alias("usd_momentum"), ((F.pmod(k * 19, F.lit(7)) - 3) / 10.0).alias("rate_momentum"), F.pmod(k * 23, F.lit(30)).cast("double").alias("vix"),
        F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("direction"),
    )


def _out(df: DataFrame, keys: list[str], doubles: list[str] = (), others: list[str] = ()) -> DataFrame:
    return df.select(*keys, *[q6(F.col(c)).alias(c) for c in doubles], *others)


KEYS = ["symbol", "tf", "ts"]
SER = ["symbol", "tf"]
OHLCV = ["open", "high", "low", "close", "volume"]


# bars and scans


@query(sql.BARS_1H + "SELECT symbol, tf, ts, open, high, low, close, volume FROM bars")
def bars_1h(spark, sf_dir):
    return market.bars(market.ticks(spark, sf_dir), 60, "1H")


@query(sql.LADDER + "SELECT symbol, tf, ts, open, high, low, close, volume FROM bars")
def bars_mtf(spark, sf_dir):
    return market.ladder(market.ticks(spark, sf_dir), sql.FIXTURE)


@query(sql.CANDLES + "SELECT symbol, tf, ts, open, high, low, close, volume FROM candles")
def drop_incomplete_bar(spark, sf_dir):
    return market.scan_candles(spark, sf_dir, sql.FIXTURE)


@query("""WITH e AS (SELECT CAST(user_id % 50 AS VARCHAR) AS account, CAST(user_id % 8 AS INTEGER) AS v, count(*) AS bars FROM events GROUP BY 1, 2),
n AS (SELECT account, v, CASE v WHEN 0 THEN 'XAUUSDxx' WHEN 1 THEN 'XAUUSDm' WHEN 2 THEN 'XAUUSD' WHEN 3 THEN 'GOLD' WHEN 4 THEN 'XAUUSDc' WHEN 5 THEN 'XAUUSD.' WHEN 6 THEN 'XAU/USD' END AS symbol FROM e WHERE v < 7)
SELECT account, arg_min(symbol, v) AS symbol FROM n GROUP BY account""")
def resolve_symbol(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in (*DEFAULT.symbol_variants, "OTHER")])
    e = market.table(spark, sf_dir, "events").groupBy(F.pmod("user_id", F.lit(50)).cast("string").alias("account"), F.element_at(names, (F.pmod("user_id", F.lit(8)) + 1).cast("int")).alias("symbol")).agg(F.count("*").alias("bars"))
    return market.resolve_symbol(e)


@query("""WITH raw AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'bad' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS t, CASE WHEN event_id % 13 = 0 THEN 'x' ELSE CAST(event_id % 97 AS VARCHAR) END AS o,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 10 AS VARCHAR) END AS v, event_type AS symbol FROM events)
SELECT symbol, count(*) AS parsed, CAST(sum(coalesce(TRY_CAST(v AS DOUBLE), 0)) AS DOUBLE) AS volume, CAST(sum(TRY_CAST(o AS DOUBLE)) AS DOUBLE) AS open_sum
FROM raw WHERE t <> 'bad' AND TRY_CAST(o AS DOUBLE) IS NOT NULL GROUP BY symbol""")
def normalise_candles(spark, sf_dir):
    k = F.col("event_id")
    price = F.when(k % 13 == 0, "x").otherwise(F.pmod(k, F.lit(97)).cast("string"))
    raw = market.table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.lit("1H").alias("tf"), F.when(k % 11 == 0, "bad").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("time"), *[price.alias(c) for c in ("open", "high", "low", "close")], F.when(k % 5 != 0, F.pmod(k, F.lit(10)).cast("string")).alias("tickVolume"))
    return market.normalise_raw(raw).groupBy("symbol").agg(F.count("*").alias("parsed"), F.sum("volume").alias("volume"), F.sum("open").alias("open_sum"))


@query(sql.CANDLES + """, x AS (SELECT * FROM candles WHERE NOT (tf = '15M' AND symbol = 'ALL')),
f AS (SELECT symbol, '15M' AS tf, ts, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rn FROM x WHERE tf = '1H' AND symbol NOT IN (SELECT symbol FROM x WHERE tf = '15M')) WHERE rn <= 40)
SELECT symbol, tf, ts, close FROM x UNION ALL SELECT symbol, tf, ts, close FROM f""")
def fallback_15m(spark, sf_dir):
    return market.fallback_15m(market.scan_candles(spark, sf_dir, sql.FIXTURE).where("not (tf = '15M' and symbol = 'ALL')")).select(*KEYS, "close")


@query(sql.LADDER + "SELECT symbol, max(ts) AS ts, arg_max(close, ts) AS price FROM bars WHERE tf = '15M' GROUP BY symbol")
def last_price(spark, sf_dir):
    return market.last_price(market.ladder(market.ticks(spark, sf_dir), sql.FIXTURE).where("tf = '15M'"))


# indicators


@query(sql.indicator("ma20, ma50, volume_ma20", others="close_above_ma20, close_above_ma50"))
def rolling_ma(spark, sf_dir):
    return _out(indicators.moving_averages(_hourly(spark, sf_dir)), KEYS, ["ma20", "ma50", "volume_ma20"], ["close_above_ma20", "close_above_ma50"])


@query(sql.indicator("bb_mid, bb_upper, bb_lower, bb_position", others="CAST(close > bbu AS INTEGER) AS close_above_bb_upper"))
def bollinger_gold(spark, sf_dir):
    df = indicators.bollinger(_hourly(spark, sf_dir), pad=1e-6).where("i >= 19")
    return _out(df, KEYS, ["bb_mid", "bb_upper", "bb_lower", "bb_position"], ["close_above_bb_upper"])


@query(sql.indicator("bbp_upper, bbp_lower, bbp_width"))
def bollinger_base(spark, sf_dir):
    df = indicators.bollinger(_hourly(spark, sf_dir), population=True)
    return _out(df.withColumnsRenamed({"bb_upper": "bbp_upper", "bb_lower": "bbp_lower", "bb_width": "bbp_width"}), KEYS, ["bbp_upper", "bbp_lower", "bbp_width"])


@query(sql.indicator("rsi_14"))
def rsi_simple(spark, sf_dir):
    return _out(indicators.rsi_simple(_hourly(spark, sf_dir)), KEYS, ["rsi_14"])


@query(sql.RECURSIVE + "SELECT symbol, tf, ts, " + sql.q6("CASE WHEN i >= 13 THEN CASE WHEN dn = 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + up / dn) END END", "rsi_wilder") + " FROM rsiw")
def rsi_wilder(spark, sf_dir):
    return _out(indicators.rsi_wilder(_hourly(spark, sf_dir)), KEYS, ["rsi_wilder"])


@query(sql.indicator("atr_14"))
def atr_simple(spark, sf_dir):
    return _out(indicators.atr_simple(_hourly(spark, sf_dir)), KEYS, ["atr_14"])


@query(sql.RECURSIVE + "SELECT symbol, tf, ts, " + sql.q6("atr", "atr_wilder") + " FROM atrw")
def atr_wilder(spark, sf_dir):
    return _out(indicators.atr_wilder(_hourly(spark, sf_dir)), KEYS, ["atr_wilder"])


@query(sql.indicator("plus_di, minus_di, adx_14"))
def adx_simple(spark, sf_dir):
    return _out(indicators.adx_simple(_hourly(spark, sf_dir)), KEYS, ["plus_di", "minus_di", "adx_14"])


@query(sql.RECURSIVE + "SELECT symbol, tf, ts, " + sql.q6("adx", "adx_wilder") + " FROM adxw")
def adx_wilder(spark, sf_dir):
    return _out(indicators.adx_wilder(_hourly(spark, sf_dir)), KEYS, ["adx_wilder"])


@query(sql.RECURSIVE + "SELECT symbol, tf, ts, " + ", ".join([sql.q6("macd", "macd"), sql.q6("sig", "macd_signal"), sql.q6("macd - sig", "macd_diff")]) + " FROM macdf")
def ewm_macd(spark, sf_dir):
    return _out(indicators.macd(_hourly(spark, sf_dir)), KEYS, ["macd", "macd_signal", "macd_diff"])


@query(sql.RECURSIVE + "SELECT symbol, tf, ts, " + ", ".join([sql.q6("CASE WHEN i >= 19 THEN e20 END", "ema20"), sql.q6("CASE WHEN i >= 49 THEN e50 END", "ema50")]) + " FROM emas")
def ema(spark, sf_dir):
    return _out(indicators.ema(_hourly(spark, sf_dir)), KEYS, ["ema20", "ema50"])


@query(sql.RECURSIVE + """, m AS (SELECT *, lag(macd) OVER w AS pm, lag(sig) OVER w AS ps, macd - sig AS d, lag(macd - sig) OVER w AS d1, lag(macd - sig, 2) OVER w AS d2 FROM macdf WINDOW w AS (PARTITION BY symbol, tf ORDER BY ts))
SELECT symbol, tf, ts, coalesce(pm < ps AND macd > sig, false) AS crossover, coalesce(d > d1 AND d1 > d2, false) AS hist_improving FROM m""")
def macd_crossover(spark, sf_dir):
    return indicators.macd_events(indicators.macd(_hourly(spark, sf_dir))).select(*KEYS, "crossover", "hist_improving")


@query(sql.indicator("returns_1, price_momentum, volatility"))
def momentum_volatility(spark, sf_dir):
    return _out(indicators.momentum(_hourly(spark, sf_dir)), KEYS, ["returns_1", "price_momentum", "volatility"])


@query(sql.indicator("volume_spike, volume_ratio"))
def volume_spike(spark, sf_dir):
    return _out(indicators.volume_spike(_hourly(spark, sf_dir)), KEYS, ["volume_spike", "volume_ratio"])


@query(sql.FEATURES + "SELECT symbol, tf, ts, " + ", ".join(sql.q6(f"coalesce(first_value({c} IGNORE NULLS) OVER (PARTITION BY symbol, tf ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0)", c) for c in ("rsi_14", "atr_14", "adx_14", "volatility")) + " FROM feat")
def bfill_features(spark, sf_dir):
    names = ("rsi_14", "atr_14", "adx_14", "volatility")
    return _out(indicators.filled(indicators.gold_features(market.bars(market.ticks(spark, sf_dir), 60, "1H")), names), KEYS, list(names))


@query(sql.FEATURES + "SELECT symbol, tf, ts, " + ", ".join(sql.q6(c, c) for c in ("rsi_14", "adx_14", "atr_14", "bb_width", "price_momentum", "volatility", "volume_spike", "usd_strength", "real_rates_momentum", "risk_sentiment", "session_hour_encoded", "day_of_week_encoded")) + ", close_above_ma20, close_above_ma50 FROM feat")
def feature_frame_gold(spark, sf_dir):
    names = ["rsi_14", "adx_14", "atr_14", "bb_width", "price_momentum", "volatility", "volume_spike", "usd_strength", "real_rates_momentum", "risk_sentiment", "session_hour_encoded", "day_of_week_encoded"]
    return _out(indicators.gold_features(market.bars(market.ticks(spark, sf_dir), 60, "1H")), KEYS, names, ["close_above_ma20", "close_above_ma50"])


@query(sql.RECURSIVE + """SELECT r.symbol, r.tf, r.ts, CAST(coalesce(CASE WHEN r.i >= 13 THEN CASE WHEN r.dn = 0 THEN false ELSE 100 - 100 / (1 + r.up / r.dn) < 35 END END, false) AS INTEGER) AS rsi_oversold, """ + sql.q6("a.atr", "atr_14") + ", " + sql.q6("x.adx", "adx_14") + ", " + sql.q6("CASE WHEN m.i >= 25 THEN m.macd END", "macd") + """
FROM rsiw r JOIN atrw a USING (symbol, tf, ts) JOIN adxw x USING (symbol, tf, ts) JOIN macdf m USING (symbol, tf, ts)""")
def feature_frame_base(spark, sf_dir):
    return _out(indicators.base_features(market.bars(market.ticks(spark, sf_dir), 60, "1H")), KEYS, ["atr_14", "adx_14", "macd"], ["rsi_oversold"])


# structure


@query(sql.SWINGS + "SELECT symbol, tf, ts, i, sh AS swing_high, sl AS swing_low FROM sw WHERE sh OR sl")
def swings(spark, sf_dir):
    return _swung(spark, sf_dir).where("swing_high or swing_low").select(*KEYS, "i", "swing_high", "swing_low")


@query(sql.STRUCTURE + "SELECT symbol, tf, nh AS n_highs, nl AS n_lows, structure FROM st")
def market_structure(spark, sf_dir):
    return structure.market_structure(_swung(spark, sf_dir))


@query(sql.STRUCTURE + "SELECT symbol, tf, j AS bos_index, " + sql.q6("level", "broken_level") + ", from_i AS swing_high_index FROM bos")
def bos_up(spark, sf_dir):
    return _out(structure.bos_up(_swung(spark, sf_dir)), SER, ["broken_level"], ["bos_index", "swing_high_index"])


@query(sql.STRUCTURE + "SELECT symbol, tf, j AS choch_index, " + sql.q6("level", "broken_level") + ", lsl AS swing_low_index FROM choch")
def choch_up(spark, sf_dir):
    return _out(structure.choch_up(_swung(spark, sf_dir)), SER, ["broken_level"], ["choch_index", "swing_low_index"])


@query(sql.STRUCTURE + "SELECT symbol, tf, j AS sweep_index, " + ", ".join([sql.q6("level", "swept_level"), sql.q6("low", "wick_low"), sql.q6("close", "close_after")]) + ", n - j AS age FROM sweep")
def liquidity_sweep(spark, sf_dir):
    return _out(structure.liquidity_sweep(_swung(spark, sf_dir)), SER, ["swept_level", "wick_low", "close_after"], ["sweep_index", "age"])


@query(sql.STRUCTURE + "SELECT symbol, tf, i AS ob_index, " + ", ".join(sql.q6(c, f"ob_{c}") for c in ("open", "high", "low", "close")) + ", mitigated FROM ob")
def order_block(spark, sf_dir):
    return _out(structure.order_block(_swung(spark, sf_dir)), SER, ["ob_open", "ob_high", "ob_low", "ob_close"], ["ob_index", "mitigated"])


@query(sql.STRUCTURE + """SELECT o.symbol, o.tf, coalesce(NOT o.mitigated AND p.last_close BETWEEN o.low - o.high * 0.005::DOUBLE AND o.high + o.high * 0.005::DOUBLE, false) AS at_block FROM ob o JOIN st p USING (symbol, tf)""")
def price_at_ob(spark, sf_dir):
    s = _swung(spark, sf_dir)
    prices = s.groupBy(*SER).agg(F.max_by("close", "i").alias("price"))
    return structure.order_block(s).join(prices, SER).select(*SER, structure.at_block(F.col("price"), F.col("ob_high"), F.col("ob_low"), F.col("mitigated")).alias("at_block"))


@query(sql.STRUCTURE + "SELECT symbol, tf, i - 1 AS fvg_index, " + ", ".join([sql.q6("round(flow, 4)", "fvg_low"), sql.q6("round(low, 4)", "fvg_high"), sql.q6("round(size * 100, 3)", "fvg_size_pct")]) + ", n - i AS age FROM fvg")
def fvg_up(spark, sf_dir):
    return _out(structure.fvg_up(indexed(market.scan_candles(spark, sf_dir, sql.FIXTURE))), SER, ["fvg_low", "fvg_high", "fvg_size_pct"], ["fvg_index", "age"])


@query(sql.STRUCTURE + "SELECT symbol, tf, zone, " + sql.q6("pct", "pct_in_range") + " FROM pd")
def premium_discount(spark, sf_dir):
    return _out(structure.premium_discount(_swung(spark, sf_dir)), SER, ["pct_in_range"], ["zone"])


@query(sql.STRUCTURE + "SELECT symbol, tf, " + sql.q6("last_close", "price") + ", " + sql.q6("round((SELECT min(high) FROM sw WHERE sw.symbol = st.symbol AND sw.tf = st.tf AND sh AND high > st.last_close * 1.001::DOUBLE), 4)", "tp_level") + " FROM st")
def nearest_tp(spark, sf_dir):
    return _out(structure.nearest_target(_swung(spark, sf_dir)), SER, ["price", "tp_level"])


@query(sql.HISTORY)
def structure_history(spark, sf_dir):
    return structure.structure_history(_swung(spark, sf_dir)).select(*KEYS, "structure")


# sessions and decisions


@query(sql.EVENTS + """SELECT event_id, CASE WHEN isodow(ts) = 6 THEN 'weekend' WHEN isodow(ts) = 5 AND hour(ts) >= 21 THEN 'friday_close' WHEN isodow(ts) = 7 AND hour(ts) < 22 THEN 'sunday_before_open'
 WHEN isodow(ts) = 5 AND day(ts) <= 7 AND CAST(ts AS TIME) BETWEEN TIME '13:25:00' AND TIME '14:05:00' THEN 'jobs_report'
 WHEN CAST(ts AS DATE) IN (""" + ", ".join(f"DATE '{d}'" for d in DEFAULT.rate_days) + """) AND hour(ts) BETWEEN 17 AND 21 THEN 'rate_statement'
 WHEN CAST(ts AS DATE) IN (""" + ", ".join(f"DATE '{d}'" for d in DEFAULT.price_days) + """) AND hour(ts) BETWEEN 13 AND 14 THEN 'price_release' END AS reason FROM ev""")
def news_guard(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", sessions.news_guard(F.col("ts")).alias("reason"))


@query(sql.EVENTS + "SELECT event_id, CASE WHEN hour(ts) IN (6, 7, 8, 9) THEN 'London Open' WHEN hour(ts) BETWEEN 11 AND 15 THEN 'NY AM' END AS killzone FROM ev")
def killzone(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", sessions.killzone(F.col("ts")).alias("killzone"))


@query(sql.EVENTS + "SELECT event_id, session, tier, isodow(ts) < 6 AS market_open, mult AS size_multiplier, gate AS confidence_gate, tier <> 'closed' AS is_trading_allowed FROM tiers")
def session_tier(spark, sf_dir):
    return sessions.session_info(_events(spark, sf_dir)).select("event_id", "session", "tier", "market_open", "size_multiplier", "confidence_gate", "is_trading_allowed")


@query(sql.EVENTS + """SELECT event_id, """ + sql.q6("10.0::DOUBLE * mult", "size") + ", " + sql.q6("2.5::DOUBLE * width", "stop_width") + """,
 CASE quality WHEN 'STRONG' THEN 3 WHEN 'MODERATE' THEN 2 WHEN 'WEAK' THEN 1 ELSE 0 END >= CASE gate WHEN 'STRONG' THEN 3 WHEN 'MODERATE' THEN 2 ELSE 1 END AS can_trade FROM tiers""")
def liquidity_adjust(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("tier", sessions.tier(F.col("ts")))
    e = e.withColumn("size", F.lit(10.0) * sessions.size_multiplier(F.col("tier"))).withColumn("stop_width", sessions.stop_width(F.lit(2.5), F.col("tier")))
    return _out(e.withColumn("can_trade", sessions.can_trade(F.col("quality"), sessions.confidence_gate(F.col("tier")))), ["event_id"], ["size", "stop_width"], ["can_trade"])


@query(sql.MACRO + "SELECT event_id, usd_trend, rate_direction, risk_mode, " + sql.q6("risk", "risk_sentiment") + """, CAST(50 + 15 * (u::INTEGER + r::INTEGER + q::INTEGER) AS INTEGER) AS smt_score, b AS is_blocked, (50 + 15 * (u::INTEGER + r::INTEGER + q::INTEGER) >= 60) AND NOT b AS is_confirmed FROM m3""")
def macro_validate(spark, sf_dir):
    m = decisions.macro_validate(decisions.macro_buckets(_events(spark, sf_dir)))
    return _out(m, ["event_id"], ["risk_sentiment"], ["usd_trend", "rate_direction", "risk_mode", "smt_score", "is_blocked", "is_confirmed"])


@query(sql.EVENTS + "SELECT event_id, " + sql.q6("c", "combined") + ", th AS threshold, c >= th AS should_trade FROM (SELECT event_id, smc_score * 0.4::DOUBLE + ml_confidence * 0.6::DOUBLE AS c, CAST(CASE tier WHEN 'peak' THEN 60 WHEN 'high' THEN 65 WHEN 'secondary' THEN 75 WHEN 'closed' THEN 100 ELSE 70 END AS INTEGER) AS th FROM tiers)")
def ml_filter_decision(spark, sf_dir):
    e = decisions.filter_decision(_events(spark, sf_dir).withColumn("tier", sessions.tier(F.col("ts"))))
    return _out(e, ["event_id"], ["combined"], ["threshold", "should_trade"])


@query(sql.EVENTS + "SELECT event_id, " + sql.q6("c", "combined") + ", th AS threshold, c >= th AS should_trade FROM (SELECT event_id, ml_confidence * 0.35::DOUBLE + coalesce(analyst_confidence, 50.0::DOUBLE) * 0.35::DOUBLE + smc_score * 0.30::DOUBLE AS c, CAST(CASE tier WHEN 'peak' THEN 50 WHEN 'high' THEN 52 WHEN 'secondary' THEN 58 WHEN 'closed' THEN 100 ELSE 52 END AS INTEGER) AS th FROM tiers)")
def composite_decision(spark, sf_dir):
    e = decisions.composite_decision(_events(spark, sf_dir).withColumn("tier", sessions.tier(F.col("ts"))))
    return _out(e, ["event_id"], ["combined"], ["threshold", "should_trade"])


@query(sql.REPLIES + """SELECT event_id, ok AS parsed, CASE WHEN ok THEN coalesce(CAST(json_extract(j, '$.should_trade') AS BOOLEAN), true) ELSE true END AS should_trade,
 CASE WHEN ok THEN greatest(coalesce(CAST(json_extract(j, '$.confidence') AS DOUBLE), 50.0), 40.0) ELSE 50.0 END::DOUBLE AS analyst_confidence,
 CASE WHEN ok THEN coalesce(json_extract_string(j, '$.reasoning'), 'no reason given') ELSE 'reply without a readable object' END AS reasoning FROM r2""")
def analyst_json_parse(spark, sf_dir):
    k = F.col("event_id")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit('Here: {"should_trade": '), F.when(k % 8 == 0, "true").otherwise("false"), F.lit(', "confidence": '), F.pmod(k, F.lit(101)).cast("string"), F.lit(', "reasoning": "r'), F.pmod(k, F.lit(9)).cast("string"), F.lit('"} done')))
        .when(k % 4 == 1, F.concat(F.lit('{"confidence": '), F.pmod(k, F.lit(101)).cast("string"), F.lit("}")))
        .when(k % 4 == 2, "no object here")
        .otherwise('{"should_trade": tru')
    )
    return decisions.parse_analyst(market.table(spark, sf_dir, "events").select("event_id", text.alias("response"))).select("event_id", "parsed", "should_trade", "analyst_confidence", "reasoning")


# scan


@query(sql.SCAN + "SELECT symbol, struct_4h, skipped, CAST(score AS INTEGER) AS score, " + sql.q6("adx_15m", "adx_15m") + ", " + sql.q6("rsi_15m", "rsi_15m") + " FROM scored")
def confluence_score(spark, sf_dir):
    return _out(scan.mtf_scan(market.scan_candles(spark, sf_dir, sql.FIXTURE)), ["symbol"], ["adx_15m", "rsi_15m"], ["struct_4h", "skipped", "score"])


@query(sql.SCAN + "SELECT symbol, sl_source, " + ", ".join(sql.q6(c, c) for c in ("price", "stop_loss", "take_profit", "rr_ratio", "sl_pct", "tp_pct", "entry_low", "entry_high")) + " FROM levels")
def signal_build(spark, sf_dir):
    return _out(scan.mtf_scan(market.scan_candles(spark, sf_dir, sql.FIXTURE)), ["symbol"], ["price", "stop_loss", "take_profit", "rr_ratio", "sl_pct", "tp_pct", "entry_low", "entry_high"], ["sl_source"])


@query(sql.SCAN + "SELECT symbol, struct_1w, struct_1d, struct_4h, struct_1h, struct_15m, at_block, sweep_index, fvg_index, zone, CAST(score AS INTEGER) AS score, tier, killzone, " + sql.q6("stop_loss", "stop_loss") + ", " + sql.q6("take_profit", "take_profit") + ", NOT skipped AND score >= 45 AND tier <> 'closed' AS fired FROM levels")
def mtf_scan(spark, sf_dir):
    s = scan.mtf_scan(market.scan_candles(spark, sf_dir, sql.FIXTURE))
    return _out(s, ["symbol"], ["stop_loss", "take_profit"], ["struct_1w", "struct_1d", "struct_4h", "struct_1h", "struct_15m", "at_block", "sweep_index", "fvg_index", "zone", "score", "tier", "killzone", "fired"])


# ledger


@query(sql.LEDGER + "SELECT system, trades, wins, losses, " + ", ".join([sql.q6("wins * 100.0::DOUBLE / trades", "win_rate"), sql.q6("pnl", "pnl"), sql.q6("10000 + pnl", "capital"), sql.q6("pnl / 10000 * 100", "return_pct"), sql.q6("CASE WHEN losses > 0 THEN won / abs(lost) ELSE won END", "profit_factor")]) + " FROM (SELECT system, count(*) AS trades, count(*) FILTER (profit_pct > 0) AS wins, count(*) FILTER (profit_pct < 0) AS losses, sum(coalesce(profit_pct, 0)) AS pnl, sum(CASE WHEN profit_pct > 0 THEN profit_pct ELSE 0 END) AS won, sum(CASE WHEN profit_pct < 0 THEN profit_pct ELSE 0 END) AS lost FROM l GROUP BY system)")
def ledger_metrics_dashboard(spark, sf_dir):
    return _out(ledger.dashboard_metrics(_ledger(spark, sf_dir)), ["system"], ["win_rate", "pnl", "capital", "return_pct", "profit_factor"], ["trades", "wins", "losses"])


@query(sql.LEDGER + "SELECT system, count(*) AS trades, count(*) FILTER (profit_pct > 0) AS wins, count(*) FILTER (profit_pct < 0) AS losses, " + sql.q6("sum(profit_pct)", "pnl") + ", " + sql.q6("count(*) FILTER (profit_pct > 0) * 100.0::DOUBLE / count(*)", "win_rate") + " FROM l WHERE NOT (system = 'A' AND status = 'BLOCKED') GROUP BY system")
def ledger_metrics_daily(spark, sf_dir):
    return _out(ledger.daily_metrics(_ledger(spark, sf_dir)), ["system"], ["pnl", "win_rate"], ["trades", "wins", "losses"])


@query(sql.LEDGER + "SELECT system, count(*) FILTER (status <> 'BLOCKED') AS total_signals, count(*) FILTER (status = 'BLOCKED') AS total_blocked, count(*) FILTER (status = 'OPEN') AS total_open, count(*) FILTER (result = 'WIN') AS total_wins, count(*) FILTER (result = 'LOSS') AS total_losses, count(*) FILTER (result = 'EXPIRED') AS total_expired, " + ", ".join([sql.q6("round(coalesce(count(*) FILTER (result = 'WIN') * 100.0::DOUBLE / nullif(count(*) FILTER (result IN ('WIN', 'LOSS')), 0), 0), 1)", "win_rate"), sql.q6("round(coalesce(avg(profit_pct) FILTER (result = 'WIN'), 0), 2)", "avg_win_pct"), sql.q6("round(coalesce(avg(profit_pct) FILTER (result = 'LOSS'), 0), 2)", "avg_loss_pct"), sql.q6("round(coalesce(sum(profit_pct), 0), 2)", "total_pnl")]) + ", count(*) FILTER (starts_with(trend, 'TREND_OK')) AS trend_passed, count(*) FILTER (starts_with(trend, 'BLOCKED')) AS trend_blocked FROM l GROUP BY system")
def ledger_running_stats(spark, sf_dir):
    return _out(ledger.running_stats(_ledger(spark, sf_dir)), ["system"], ["win_rate", "avg_win_pct", "avg_loss_pct", "total_pnl"], ["total_signals", "total_blocked", "total_open", "total_wins", "total_losses", "total_expired", "trend_passed", "trend_blocked"])


@query(sql.LEDGER + "SELECT system, round(sum(profit_pct) FILTER (result = 'WIN') / abs(sum(profit_pct) FILTER (result = 'LOSS')), 2) AS profit_factor FROM l GROUP BY system")
def profit_factor(spark, sf_dir):
    return ledger.profit_factor(_ledger(spark, sf_dir), "system")


@query(sql.LEDGER + """, o AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY exit_time DESC, signal_id DESC) AS rn, first_value(result) OVER (PARTITION BY system ORDER BY exit_time DESC, signal_id DESC) AS kind FROM l WHERE result IS NOT NULL),
s AS (SELECT system, kind, coalesce(min(rn) FILTER (result <> kind) - 1, count(*)) AS k FROM o GROUP BY system, kind)
SELECT system, CASE WHEN kind = 'WIN' THEN k ELSE 0 END AS consecutive_wins, CASE WHEN kind = 'LOSS' THEN k ELSE 0 END AS consecutive_losses FROM s""")
def streaks(spark, sf_dir):
    return ledger.streaks(_ledger(spark, sf_dir))


@query(sql.LEDGER + """SELECT system, first(signal_id ORDER BY profit_pct DESC, signal_id) FILTER (result = 'WIN') AS best_id, max(profit_pct) FILTER (result = 'WIN') AS best_pct,
 first(signal_id ORDER BY profit_pct, signal_id) FILTER (result = 'LOSS') AS worst_id, min(profit_pct) FILTER (result = 'LOSS') AS worst_pct FROM l GROUP BY system""")
def best_worst(spark, sf_dir):
    return ledger.best_worst(_ledger(spark, sf_dir))


@query(sql.LEDGER + "SELECT signal_quality, count(*) AS n FROM l WHERE status <> 'BLOCKED' GROUP BY signal_quality")
def quality_histogram(spark, sf_dir):
    return ledger.quality_histogram(_ledger(spark, sf_dir))


@query(sql.LEDGER + "SELECT system, signal_id, " + sql.q6("10000 + e", "equity") + " FROM (SELECT *, sum(coalesce(profit_pct, 0)) OVER (PARTITION BY system ORDER BY signal_id) AS e, row_number() OVER (PARTITION BY system ORDER BY signal_id DESC) AS rn FROM l) WHERE rn <= 50")
def equity_curve(spark, sf_dir):
    return _out(ledger.equity_curve(_ledger(spark, sf_dir)), ["system", "signal_id"], ["equity"])


@query(sql.LEDGER + "SELECT signal_id, strftime(timestamp, '%Y-%m-%d') AS date, CASE WHEN stop_loss > entry_price THEN 'SHORT' ELSE 'LONG' END AS direction, entry_price, stop_loss, signal_quality, result, profit_pct, left(summary, 200) AS summary FROM l WHERE result IS NOT NULL ORDER BY exit_time DESC, signal_id DESC LIMIT 5")
def recent_closed(spark, sf_dir):
    return ledger.recent_closed(_ledger(spark, sf_dir))


@query(sql.LEDGER + "SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS signals FROM l WHERE status <> 'BLOCKED' GROUP BY 1")
def daily_signal_count(spark, sf_dir):
    return ledger.daily_count(_ledger(spark, sf_dir))


@query(sql.LEDGER + "SELECT count(*) AS closed, count(*) FILTER (profit_pct IS NULL) AS unknown FROM l WHERE profit_pct <> 0 OR profit_pct IS NULL")
def closed_filter(spark, sf_dir):
    return ledger.closed_trades(_ledger(spark, sf_dir)).agg(F.count("*").alias("closed"), F.count_if(F.col("profit_pct").isNull()).alias("unknown"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'np.float64(' || CAST(4000 + event_id % 500 AS VARCHAR) || '.25)' WHEN 1 THEN '[np.float64(' || CAST(4000 + event_id % 500 AS VARCHAR) || '.5)]' WHEN 2 THEN '[' || CAST(4000 + event_id % 500 AS VARCHAR) || '.75]' ELSE '[none]' END AS x FROM events)
SELECT event_id, coalesce(nullif(regexp_extract(x, '\\((\\d+\\.?\\d*)\\)', 1), ''), nullif(regexp_extract(x, '(\\d{4,}\\.\\d+)', 1), ''), 'N/A') AS target FROM t""".replace("\\\\", "\\"))
def tp_regex_clean(spark, sf_dir):
    k, n = F.col("event_id"), (4000 + F.pmod("event_id", F.lit(500))).cast("string")
    text = F.when(k % 4 == 0, F.concat(F.lit("np.float64("), n, F.lit(".25)"))).when(k % 4 == 1, F.concat(F.lit("[np.float64("), n, F.lit(".5)]"))).when(k % 4 == 2, F.concat(F.lit("["), n, F.lit(".75]"))).otherwise("[none]")
    return market.table(spark, sf_dir, "events").select("event_id", ledger.clean_target(text).alias("target"))


def _trades(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every fourth hourly bar of a symbol opens a trade (fixture); its candles; its as-of time."""
    candles = market.bars(market.ticks(spark, sf_dir), 60, "1H")
    df = indexed(candles)
    k = F.col("i") + 1
    w = F.when(k % 8 == 0, 0.0002).otherwise(0.004)
    trades = df.where(k % 4 == 0).select(F.concat_ws("-", "symbol", k.cast("string")).alias("signal_id"), "symbol", F.col("ts").alias("entry_ts"), F.col("close").alias("entry_price"), (F.col("close") * (1 - w)).alias("stop_loss"), (F.col("close") * (1 + 2 * w)).alias("take_profit"))
    as_of = candles.groupBy("symbol").agg((F.max("ts") + F.expr("interval 1 hour")).alias("as_of"), F.max_by("close", "ts").alias("last_close"))
    return trades, candles, as_of


@query(sql.TRADES + "SELECT signal_id, status, reason AS exit_reason, " + sql.q6("exit_price", "exit_price") + ", " + sql.q6("round((exit_price - entry) / entry * 100, 4)", "profit_pct") + " FROM snap")
def barrier_resolve_snapshot(spark, sf_dir):
    return _out(ledger.resolve_snapshot(*_trades(spark, sf_dir)), ["signal_id"], ["exit_price", "profit_pct"], ["status", "exit_reason"])


@query(sql.TRADES + "SELECT signal_id, status, reason AS exit_reason, " + sql.q6("exit_price", "exit_price") + ", " + sql.q6("round((exit_price - entry) / entry * 100, 4)", "profit_pct") + " FROM replay")
def barrier_resolve_replay(spark, sf_dir):
    return _out(ledger.resolve_replay(*_trades(spark, sf_dir)), ["signal_id"], ["exit_price", "profit_pct"], ["status", "exit_reason"])


@query(sql.LEDGER + """, w AS (SELECT *, coalesce(sum(profit_pct) OVER (PARTITION BY system, CAST(timestamp AS DATE) ORDER BY timestamp, signal_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dp,
 count(*) FILTER (status = 'OPEN') OVER (PARTITION BY system ORDER BY timestamp, signal_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ob,
 last_value(CASE WHEN result = 'LOSS' THEN exit_time END IGNORE NULLS) OVER (PARTITION BY system ORDER BY timestamp, signal_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ll FROM l)
SELECT signal_id, """ + sql.q6("dp", "day_pnl") + """, ob AS open_before, coalesce(timestamp < ll + INTERVAL 40 MINUTE, false) AS in_cooldown FROM w""")
def risk_gates(spark, sf_dir):
    return _out(ledger.cooldown(_ledger(spark, sf_dir)), ["signal_id"], ["day_pnl"], ["open_before", "in_cooldown"])


@query(sql.LEDGER + "SELECT system, 'System ' || system || ': ' || trades || ' trades, win rate ' || printf('%.1f', wr) || '%, P&L ' || CASE WHEN pnl < 0 THEN '-$' ELSE '+$' END || format('{:,.2f}', abs(pnl)) || ', profit factor ' || printf('%.2f', pf) AS message FROM (SELECT system, count(*) AS trades, count(*) FILTER (profit_pct > 0) * 100.0::DOUBLE / count(*) AS wr, sum(coalesce(profit_pct, 0)) AS pnl, sum(CASE WHEN profit_pct > 0 THEN profit_pct END) / abs(sum(CASE WHEN profit_pct < 0 THEN profit_pct END)) AS pf FROM l GROUP BY system)")
def metrics_message(spark, sf_dir):
    return ledger.metrics_text(ledger.dashboard_metrics(_ledger(spark, sf_dir)))


@query(sql.BARS_1H + """, q AS (SELECT max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS k FROM events GROUP BY time_bucket(INTERVAL 15 MINUTE, ts)),
macro AS (SELECT ts, ((k * 17) % 21 - 10) / 10.0::DOUBLE AS u, ((k * 19) % 7 - 3) / 10.0::DOUBLE AS r, CAST((k * 23) % 100 AS DOUBLE) AS k FROM q)
SELECT b.symbol, b.ts, coalesce(m.u, 0) AS usd_strength, coalesce(m.r, 0) AS real_rates_momentum, coalesce(m.k, 50) AS risk_sentiment FROM bars b ASOF LEFT JOIN macro m ON b.ts >= m.ts""")
def macro_asof(spark, sf_dir):
    """Hourly bars with the macro row in force; the macro rows are the newest events of every quarter of an hour (fixture)."""
    e = market.table(spark, sf_dir, "events").groupBy(market.bucket(F.col("ts"), 15).alias("q")).agg(F.max(F.struct("ts", "event_id")).alias("m")).select("m.ts", F.col("m.event_id").alias("k"))
    macro = e.select("ts", ((F.pmod(F.col("k") * 17, F.lit(21)) - 10) / 10.0).alias("usd_strength"), ((F.pmod(F.col("k") * 19, F.lit(7)) - 3) / 10.0).alias("real_rates_momentum"), F.pmod(F.col("k") * 23, F.lit(100)).cast("double").alias("risk_sentiment"))
    return indicators.with_macro(_hourly(spark, sf_dir), macro).select("symbol", "ts", "usd_strength", "real_rates_momentum", "risk_sentiment")


@query("""WITH s AS (SELECT date_trunc('hour', ts) AS ts, count(*) AS scanned, count(*) FILTER (value > 80) AS sh, count(*) FILTER (value > 99) AS lg, count(*) FILTER (value < 1) AS bl FROM events GROUP BY 1),
l AS (SELECT *, ts + INTERVAL 1 HOUR AS lt FROM s)
SELECT ts, CASE WHEN lg > 0 OR bl > 0 OR hour(lt) = 0 THEN 'Scan complete, ' || strftime(lt, '%Y-%m-%d %H:%M') || chr(10) || CASE WHEN lg = 0 AND bl = 0 THEN 'No signals today so far' WHEN lg > 0 THEN 'Signals found' ELSE 'Signals blocked by risk rules' END
 || chr(10) || 'Scanned: ' || scanned || chr(10) || 'Shortlisted: ' || sh || ', logged: ' || lg || ', blocked: ' || bl || chr(10) || 'Open paper trades: 3/15' END AS message FROM l""")
def scan_heartbeat(spark, sf_dir):
    v = F.col("value")
    hours = market.table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("scanned"), F.count_if(v > 80).alias("shortlisted"), F.count_if(v > 99).alias("signals_logged"), F.count_if(v < 1).alias("signals_blocked"))
    return reports.scan_summary(hours.withColumn("open_trades", F.lit(3))).select("ts", "message")


@query(sql.LEDGER + """, s AS (SELECT system, count(*) FILTER (status = 'OPEN') AS o, count(*) FILTER (result = 'WIN') AS w, count(*) FILTER (result = 'LOSS') AS s, count(*) FILTER (result = 'EXPIRED') AS x, sum(profit_pct) AS p,
 sum(profit_pct) FILTER (result = 'WIN') / abs(sum(profit_pct) FILTER (result = 'LOSS')) AS f, first(signal_id ORDER BY profit_pct DESC, signal_id) FILTER (result = 'WIN') AS bi, max(profit_pct) FILTER (result = 'WIN') AS bp,
 first(signal_id ORDER BY profit_pct, signal_id) FILTER (result = 'LOSS') AS wi, min(profit_pct) FILTER (result = 'LOSS') AS wp, date_diff('day', min(timestamp), max(timestamp)) + 1 AS d,
 count(*) FILTER (signal_quality = 'STRONG' AND status <> 'BLOCKED') AS q1, count(*) FILTER (signal_quality = 'MODERATE' AND status <> 'BLOCKED') AS q2, count(*) FILTER (signal_quality = 'WEAK' AND status <> 'BLOCKED') AS q3,
 count(*) FILTER (starts_with(trend, 'TREND_OK')) AS a, count(*) FILTER (starts_with(trend, 'BLOCKED')) AS b FROM l GROUP BY system)
SELECT system, 'Days running: ' || d || chr(10) || 'Open trades: ' || o || '/15' || chr(10) || 'Wins: ' || w || ', losses: ' || s || ', expired: ' || x || chr(10) || 'Win rate: ' || format('{:,.1f}', w * 100.0::DOUBLE / (w + s)) || '%' || chr(10)
 || 'Cumulative result: ' || CASE WHEN p > 0 THEN '+' ELSE '' END || format('{:,.2f}', p) || '%' || chr(10) || 'Profit factor: ' || format('{:,.2f}', round(f, 2)) || chr(10) || 'Best: ' || bi || ' +' || format('{:,.2f}', bp) || '%, worst: ' || wi || ' ' || format('{:,.2f}', wp) || '%' || chr(10)
 || 'Strong: ' || q1 || ', moderate: ' || q2 || ', weak: ' || q3 || chr(10) || 'Trend filter passed: ' || a || ', blocked: ' || b AS message FROM s""")
def daily_report(spark, sf_dir):
    return reports.daily_report(reports.report_stats(_ledger(spark, sf_dir))).select("system", "message")


@query(sql.LEDGER + """SELECT 'XAUUSD' AS pair, '?' AS direction, CASE WHEN profit_pct > 0 THEN 'WIN' WHEN profit_pct < 0 THEN 'LOSS' ELSE 'OPEN' END AS outcome, CASE WHEN coalesce(profit_pct, 0) < 0 THEN '-$' ELSE '+$' END || format('{:,.2f}', abs(coalesce(profit_pct, 0))) AS pnl, strftime(timestamp, '%Y-%m-%d') AS date
 FROM l ORDER BY timestamp DESC, signal_id DESC LIMIT 10""")
def dashboard_rows(spark, sf_dir):
    return reports.dashboard_rows(_ledger(spark, sf_dir), tie="signal_id").select("pair", "direction", "outcome", "pnl", "date")


@query(sql.LEDGER + "SELECT " + ", ".join(f"count(*) FILTER (system = '{s}') AS trades_{s.lower()}, count(*) FILTER (system = '{s}' AND profit_pct > 0) AS wins_{s.lower()}, " + sql.q6(f"coalesce(sum(profit_pct) FILTER (system = '{s}'), 0)", f"pnl_{s.lower()}") for s in ("A", "C")) + " FROM l")
def system_comparison(spark, sf_dir):
    c = reports.comparison(ledger.dashboard_metrics(_ledger(spark, sf_dir)))
    return c.select("trades_a", "wins_a", q6(F.col("pnl_a")).alias("pnl_a"), "trades_c", "wins_c", q6(F.col("pnl_c")).alias("pnl_c"))


@query(sql.LEDGER + """, d AS (SELECT system, CAST(timestamp AS DATE) AS day, coalesce(sum(profit_pct), 0) AS p FROM l GROUP BY ALL), w AS (SELECT *, sum(p) OVER (PARTITION BY system, date_trunc('week', day) ORDER BY day) AS wp FROM d)
SELECT system, day, """ + sql.q6("p", "day_pnl") + ", " + sql.q6("wp", "week_pnl") + ", round(p, 6) <= -3 OR round(wp, 6) <= -6 AS stopped FROM w")
def loss_caps(spark, sf_dir):
    caps = reports.loss_caps(_ledger(spark, sf_dir).withColumn("profit_pct", F.col("profit_pct")))
    return caps.select("system", "day", q6(F.col("day_pnl")).alias("day_pnl"), q6(F.col("week_pnl")).alias("week_pnl"), ((q6(F.col("day_pnl")) <= -3) | (q6(F.col("week_pnl")) <= -6)).alias("stopped"))


@query(sql.EVENTS + "SELECT event_id, " + sql.q6("least(greatest(ml_confidence / 100 - (1 - ml_confidence / 100) / 2, 0), 0.25)", "kelly") + ", " + sql.q6("5000 * mult * CASE WHEN ml_confidence < 40 THEN 0.5 WHEN ml_confidence > 60 THEN 1.5 ELSE 1 END", "size") + " FROM tiers")
def position_size(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("size_multiplier", sessions.size_multiplier(sessions.tier(F.col("ts")))).withColumn("win_rate", F.col("ml_confidence")).withColumn("rr_ratio", F.lit(2.0))
    return _out(reports.position_size(e), ["event_id"], ["kelly", "size"])


@query(sql.SCAN + "SELECT symbol, no AS target_no, share, " + sql.q6("price + (take_profit - price) * share", "target_price") + " FROM levels, (VALUES (1, 0.33::DOUBLE), (2, 0.67::DOUBLE), (3, 1.0::DOUBLE)) v(no, share)")
def partial_targets(spark, sf_dir):
    return _out(decisions.split_targets(scan.mtf_scan(market.scan_candles(spark, sf_dir, sql.FIXTURE))), ["symbol"], ["target_price"], ["target_no", "share"])


@query("""WITH r AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'no time' WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS t, date_trunc('second', ts) AS ts FROM events)
SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN ts END AS parsed, strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M') AS shown FROM r""")
def time_parsing(spark, sf_dir):
    k = F.col("event_id")
    text = F.when(k % 9 == 0, "no time").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 2 == 0, "Z").otherwise("")))
    return market.table(spark, sf_dir, "events").select("event_id", sessions.parse_iso(text).alias("parsed"), sessions.local_text(F.col("ts")).alias("shown"))


@query(sql.PRICED + ", " + " UNION ALL ".join(
    [f"{'bars AS (' if k == 0 else ''}SELECT symbol, '{t}' AS tf, CAST(date_trunc('{unit}', p.ts) AS TIMESTAMP) AS ts, {sql._BAR} FROM priced p GROUP BY symbol, date_trunc('{unit}', p.ts)" for k, (t, unit) in enumerate((("1D", "day"), ("1W", "week")))]
) + ") SELECT symbol, tf, ts, open, high, low, close, volume FROM bars")
def bars_day_week(spark, sf_dir):
    """Days, and weeks from Monday: the lengths of the default ladder."""
    return market.ladder(market.ticks(spark, sf_dir)).where("tf in ('1D', '1W')")


@query(sql.LADDER.replace("FROM priced p, roles", "FROM (SELECT * FROM priced WHERE ts < TIMESTAMP '2024-01-20 12:00:00') p, roles") + f""", k AS (SELECT bars.*, least, row_number() OVER (PARTITION BY symbol, bars.tf ORDER BY ts DESC) AS rn FROM bars JOIN roles USING (tf)),
z AS (SELECT * FROM k QUALIFY rn BETWEEN 2 AND 100 AND count(*) FILTER (rn <= 100) OVER (PARTITION BY symbol, tf) >= least)
SELECT symbol, tf, ts, close FROM z WHERE ts >= TIMESTAMP '2024-01-19 00:00:00'""")
def scan_as_of(spark, sf_dir):
    """The scan's candles as they were at a time (the bar of that time is cut there), and of these the ones since another."""
    ticks = market.ticks(spark, sf_dir).where("ts < timestamp_ntz '2024-01-20 12:00:00'")
    candles = market.drop_incomplete(market.ladder(ticks, sql.FIXTURE), sql.FIXTURE, fetch=100, end="2024-01-20 12:00:00")
    return market.since(candles, "2024-01-19 00:00:00").select(*KEYS, "close")


SPANS = (1, 2, 3, 200, 1000)


@query(sql.PRICED + f""", bars AS (SELECT symbol, '10m' AS tf, time_bucket(INTERVAL 10 MINUTE, p.ts) AS ts, {sql._BAR} FROM priced p GROUP BY symbol, time_bucket(INTERVAL 10 MINUTE, p.ts)),
c AS (SELECT *, row_number() {sql.W} - 1 AS i FROM bars)
SELECT a.symbol, a.ts, """ + ", ".join(f"round(sum(CASE WHEN b.i = 0 THEN b.close ELSE b.close * (2.0::DOUBLE / {n + 1}) END * pow({n - 1}.0::DOUBLE / {n + 1}, a.i - b.i)) * 1000) / 1000 AS span_{n}" for n in SPANS) + " FROM c a JOIN c b ON b.symbol = a.symbol AND b.i <= a.i GROUP BY a.symbol, a.ts")
def ewm_spans(spark, sf_dir):
    """Exponential means of every kind of span over long series, whose blocks are from 1 to 10^4 rows."""
    df = rolling.ewm(indexed(market.bars(market.ticks(spark, sf_dir), 10)), {f"span_{n}": (F.col("close"), 2 / (n + 1)) for n in SPANS})
    return df.select("symbol", "ts", *[(F.round(F.col(f"span_{n}") * 1000) / 1000).alias(f"span_{n}") for n in SPANS])


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN ['XAUUSDxx', 'XAUUSDm', 'XAUUSD', 'GOLD', 'XAUUSDc', 'XAUUSD.', 'XAU/USD', 'OTHER'][user_id % 8 + 1] END AS symbol FROM events)
SELECT event_id, symbol FROM e WHERE coalesce(contains(symbol, 'XAUUSD'), false)""")
def symbol_contains(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in (*DEFAULT.symbol_variants, "OTHER")])
    symbol = F.when(F.col("event_id") % 9 != 0, F.element_at(names, (F.pmod("user_id", F.lit(8)) + 1).cast("int")))
    return ledger.of_symbol(market.table(spark, sf_dir, "events").select("event_id", symbol.alias("symbol")), "XAUUSD")


@query(sql.CANDLES + sql.recursive("candles") + """, mw AS (SELECT * FROM macdf WHERE i >= 25),
sg AS (SELECT a.symbol, a.tf, a.i, a.macd, sum(CASE WHEN b.i = 25 THEN b.macd ELSE b.macd * 0.2::DOUBLE END * pow(0.8::DOUBLE, a.i - b.i)) AS sig FROM mw a JOIN mw b ON b.symbol = a.symbol AND b.tf = a.tf AND b.i <= a.i GROUP BY ALL),
sw AS (SELECT *, lag(macd) OVER (PARTITION BY symbol, tf ORDER BY i) AS pm, lag(CASE WHEN i >= 33 THEN sig END) OVER (PARTITION BY symbol, tf ORDER BY i) AS ps FROM sg),
vr AS (SELECT symbol, tf, i, volume, avg(volume) OVER (PARTITION BY symbol, tf ORDER BY i ROWS 19 PRECEDING) AS vm FROM c),
nw AS (SELECT c.symbol, c.tf, c.close AS price, CASE WHEN r.dn = 0 THEN 100 ELSE 100 - 100 / (1 + r.up / r.dn) END AS rsi, e.e20, e.e50, w.macd, CASE WHEN w.i >= 33 THEN w.sig END AS sig, coalesce(w.pm < w.ps AND w.macd > w.sig, false) AS crossed, round(v.volume / v.vm, 2) AS ratio
 FROM c JOIN rsiw r ON r.symbol = c.symbol AND r.tf = c.tf AND r.i = c.i JOIN emas e ON e.symbol = c.symbol AND e.tf = c.tf AND e.i = c.i JOIN vr v ON v.symbol = c.symbol AND v.tf = c.tf AND v.i = c.i LEFT JOIN sw w ON w.symbol = c.symbol AND w.tf = c.tf AND w.i = c.i WHERE c.i = c.n - 1)
SELECT h.symbol, """ + ", ".join([sql.q6("h.rsi", "rsi_1h"), sql.q6("f.rsi", "rsi_4h"), sql.q6("coalesce(h.macd, 0)", "macd_1h"), sql.q6("coalesce(h.sig, 0)", "signal_1h"), sql.q6("h.ratio", "volume_ratio"), sql.q6("coalesce(f.e20, h.price)", "ema20_4h"), sql.q6("coalesce(f.e50, h.price)", "ema50_4h")]) + """,
 h.crossed AS crossover_1h, CASE WHEN h.e20 > h.e50 THEN 'EMA20>EMA50' ELSE 'EMA20<EMA50' END AS ema_status_1h, CASE WHEN coalesce(f.e20, h.price) > coalesce(f.e50, h.price) THEN 'EMA20>EMA50' ELSE 'EMA20<EMA50' END AS ema_status_4h,
 h.price > coalesce(w.e50, h.price) AS trend_up, h.price > coalesce(f.e50, h.price) AS price_above_ema50
FROM nw h LEFT JOIN nw f ON f.symbol = h.symbol AND f.tf = '4H' LEFT JOIN nw w ON w.symbol = h.symbol AND w.tf = '1W' WHERE h.tf = '1H'""")
def signal_display(spark, sf_dir):
    d = scan.display_record(market.scan_candles(spark, sf_dir, sql.FIXTURE))
    return _out(d, ["symbol"], ["rsi_1h", "rsi_4h", "macd_1h", "signal_1h", "volume_ratio", "ema20_4h", "ema50_4h"], ["crossover_1h", "ema_status_1h", "ema_status_4h", "trend_up", "price_above_ema50"])


@query(sql.LEDGER + "SELECT status, count(*) AS trades, " + sql.q6("coalesce(sum(profit_pct), 0)", "pnl") + ", count(*) FILTER (signal_quality = 'STRONG') AS strong, 0::BIGINT AS missing FROM l GROUP BY status")
def ledger_files(spark, sf_dir):
    """A ledger written, appended to and read again; a path that is not there is an empty ledger."""
    place = ledger.work_folder(spark)
    rows = _ledger(spark, sf_dir)
    text = rows.select(*[F.col(c).cast("string").alias(c) if c in rows.columns else F.lit("").alias(c) for c in ledger.LEDGER_A])
    ledger.write_ledger(text.where("signal_id % 2 = 0"), f"{place}/a")
    ledger.append_ledger(text.where("signal_id % 2 = 1"), f"{place}/a")
    back = ledger.read_ledger(spark, f"{place}/a").unionByName(ledger.read_ledger(spark, f"{place}/none"))
    missing = F.count_if(F.col("signal_id") == "")
    out = back.groupBy("status").agg(F.count("*").alias("trades"), F.coalesce(F.sum(ledger.number(F.col("profit_pct"))), F.lit(0.0)).alias("pnl"), F.count_if(F.col("signal_quality") == "STRONG").alias("strong"), missing.alias("missing"))
    return _out(out, ["status"], ["pnl"], ["trades", "strong", "missing"])


@query("""SELECT upper(left(sha256('XAUUSD|' || strftime(o_orderdate, '%Y-%m-%d') || '|' || CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END || '|' || o_orderkey), 8)) AS signal_id, CAST(o_orderkey AS VARCHAR) AS entry_price,
 CASE WHEN o_orderkey % 5 = 0 THEN 'spread' ELSE '' END AS blocked_reason, CASE WHEN o_orderkey % 5 = 0 THEN 'BLOCKED' ELSE 'OPEN' END AS status FROM orders""")
def log_signals(spark, sf_dir):
    k = F.col("o_orderkey")
    signals = market.table(spark, sf_dir, "orders").select(F.lit("XAUUSD").alias("symbol"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("timestamp"), F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("direction"), k.cast("string").alias("entry_price"), F.when(k % 5 == 0, "spread").alias("blocked_reason"))
    empty = spark.createDataFrame([], ledger.text_schema(ledger.LEDGER_A))
    return ledger.log_signals(empty, signals).select("signal_id", "entry_price", "blocked_reason", "status")


@query("""WITH s AS (SELECT event_type AS symbol, CAST(count(*) % 101 AS DOUBLE) AS score, CAST(max(event_id) % 101 AS DOUBLE) AS ml, ['bullish', 'bearish', 'ranging'][max(event_id) % 3 + 1] AS st FROM events GROUP BY 1),
p AS (SELECT symbol, string_agg(line, chr(10) ORDER BY event_id) AS lines FROM (SELECT event_type AS symbol, event_id, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END || ' ' || event_type || ' from ' || (2000 + event_id) || ', result ' || event_id % 7 AS line,
 row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events WHERE event_type <> 'purchase') WHERE rn <= 3 GROUP BY symbol)
SELECT symbol, CASE WHEN st = 'bullish' THEN 'BUY' ELSE 'SELL' END AS direction, 'Signal: ' || CASE WHEN st = 'bullish' THEN 'BUY' ELSE 'SELL' END || ' ' || symbol || ', score ' || printf('%.0f', score) || ' of 100, price 2400.5000' || chr(10) || 'Levels: stop 2390.2500, target unknown' || chr(10)
 || 'Model: ' || printf('%.0f', ml) || ' of 100' || chr(10) || 'Market: 4H ' || st || ', 1H unknown, RSI unknown, ATR unknown, volatility unknown, news unknown' || chr(10) || 'Open positions:' || chr(10) || coalesce(lines, 'none') || chr(10)
 || 'Reply with one JSON object: should_trade, confidence from 0 to 100, reasoning.' AS prompt FROM s LEFT JOIN p USING (symbol)""")
def analyst_prompt(spark, sf_dir):
    e, k = market.table(spark, sf_dir, "events"), F.col("event_id")
    newest = F.pmod(F.max("event_id"), F.lit(3)).cast("int")
    sig = e.groupBy(F.col("event_type").alias("symbol")).agg(
        F.pmod(F.count("*"), F.lit(101)).cast("double").alias("smc_score"), F.pmod(F.max("event_id"), F.lit(101)).cast("double").alias("ml_confidence"), F.element_at(F.array(F.lit("bullish"), F.lit("bearish"), F.lit("ranging")), newest + 1).alias("struct_4h")
    ).withColumns({"price": F.lit(2400.5), "stop_loss": F.lit(2390.25), "take_profit": F.lit(None).cast("double"), "direction": decisions.direction(F.col("struct_4h"))})
    held = e.where("event_type <> 'purchase'").select(F.col("event_type").alias("symbol"), k.alias("signal_id"), F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("direction"), (k + 2000).alias("entry_price"), F.pmod(k, F.lit(7)).alias("pnl"))
    return decisions.analyst_prompt(sig, held).select("symbol", "direction", "prompt")


def _streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table read as a stream."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    read = spark.readStream.schema(spark.read.parquet(path).schema)
    # a stream reads a folder; a single file is found by its name
    folder, file = path.rsplit("/", 1)
    return read.parquet(path) if spark.read.format("binaryFile").load(path).select("path").limit(2).count() > 1 else read.option("pathGlobFilter", file).parquet(folder)


def _runs(rows: DataFrame, slices: list, place: str, start: Callable) -> None:
    """Rows that arrive slice by slice (a condition each) in a folder, and a stream of them that is started for each, from its checkpoint."""
    for k, mine in enumerate(slices):
        rows.where(mine).write.mode("append").parquet(f"{place}/in")
        stream = rows.sparkSession.readStream.schema(rows.schema).parquet(f"{place}/in")
        start(stream, f"{place}/state").trigger(availableNow=True).start().awaitTermination()


@query("""WITH b AS (SELECT event_type AS symbol, time_bucket(INTERVAL 1 HOUR, ts) AS bar, count(*) AS n, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close FROM events GROUP BY 1, 2)
SELECT symbol, bar AS ts, open, high, low, close, CAST(n AS DOUBLE) AS volume FROM b WHERE bar + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_bars(spark, sf_dir):
    """Hourly bars of the events read as a stream, until the stream's end; the bars the watermark has not passed stay open."""
    place = ledger.work_folder(spark)
    stream = _streamed(spark, sf_dir, "events")
    ticks = stream.select(F.col("event_type").alias("symbol"), "event_id", "ts", F.col("value").alias("price"))
    done = streaming.stream_bars(ticks, 60).writeStream.format("parquet").option("path", f"{place}/bars").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{place}/bars").select("symbol", "ts", "open", "high", "low", "close", "volume")


@query(sql.TRADES + "SELECT signal_id, status, reason AS exit_reason, " + sql.q6("exit_price", "exit_price") + ", " + sql.q6("round((exit_price - entry) / entry * 100, 4)", "profit_pct") + " FROM replay")
def barrier_resolve_stream(spark, sf_dir):
    """Trades and candles made from the events arrive as a stream, which ends in the middle and goes on from its checkpoint; what never closed is open."""
    trades, candles, as_of = _trades(spark, sf_dir)
    place = ledger.work_folder(spark)
    candles.write.parquet(f"{place}/candles")
    trades.write.parquet(f"{place}/trades")
    candles, trades = spark.read.parquet(f"{place}/candles"), spark.read.parquet(f"{place}/trades")
    middle = candles.agg(F.timestamp_seconds((F.unix_seconds(F.min("ts").cast("timestamp")) + F.unix_seconds(F.max("ts").cast("timestamp"))) / 2)).first()[0]
    out = lambda rows, state: resolver.resolve_stream(rows).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", state)
    with resolver.use_state(spark):
        _runs(resolver.feed(trades, candles, as_of), [F.col("ts") < F.lit(middle), F.col("ts") >= F.lit(middle)], place, out)
    closed = spark.read.parquet(f"{place}/out")
    rest = trades.join(closed, "signal_id", "left_anti").select("signal_id", F.lit("OPEN").alias("status"), F.lit(None).cast("string").alias("exit_reason"), F.lit(None).cast("double").alias("exit_price"), F.lit(None).cast("double").alias("profit_pct"))
    return _out(closed.select(*rest.columns).unionByName(rest), ["signal_id"], ["exit_price", "profit_pct"], ["status", "exit_reason"])


@query(sql.BARS_1H + "SELECT symbol, tf, ts, open, high, low, close, volume FROM bars")
def late_bars(spark, sf_dir):
    """The events' ticks in slices without an order of time, one of them sent again: every bar ends as it is in ``bars_1h``."""
    place = ledger.work_folder(spark)
    part = F.pmod(F.xxhash64("event_id"), F.lit(3))
    table = late.RevisedBars(spark, place, 60, "1H")
    _runs(market.ticks(spark, sf_dir), [part == 2, part == 0, part == 2, part == 1], place, table.follow)
    return table.bars()


@query(sql.LEDGER + "SELECT CAST(signal_id AS VARCHAR) AS signal_id, CASE WHEN status = 'CLOSED' THEN result ELSE status END AS status, " + sql.q6("profit_pct", "profit_pct") + ", coalesce(strftime(exit_time, '%Y-%m-%d %H:%M:%S'), '') AS exit_time, CASE WHEN status = 'BLOCKED' THEN 'risk' ELSE '' END AS blocked_reason FROM l")
def ledger_stream(spark, sf_dir):
    """Signals and outcomes of the orders arrive as a stream, signals of every third once more with the outcomes; the ledger has each once, and is compacted."""
    orders, place = _ledger(spark, sf_dir), ledger.work_folder(spark)
    names = ["signal_id", "timestamp", "symbol", "signal_quality", "entry_price", "stop_loss", F.when(F.col("status") == "BLOCKED", "risk").alias("blocked_reason")]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("status", "string"), ("exit_price", "double"), ("exit_ts", "timestamp_ntz"), ("exit_reason", "string"), ("profit_pct", "double"))]
    signals = orders.select(*names, *none, F.lit(False).alias("outcome"), F.lit(0).alias("slice"))
    again = signals.where("signal_id % 3 = 0").withColumn("slice", F.lit(1))
    closed = orders.where("status = 'CLOSED'").select(
        "signal_id", "timestamp", "symbol", "signal_quality", "entry_price", "stop_loss", F.lit(None).cast("string").alias("blocked_reason"), F.col("result").alias("status"), F.col("entry_price").alias("exit_price"), F.col("exit_time").alias("exit_ts"), F.lit("fixture").alias("exit_reason"), "profit_pct", F.lit(True).alias("outcome"), F.lit(1).alias("slice")
    )
    table = ledger_table.LedgerTable(spark, f"{place}/ledger")
    _runs(signals.unionByName(again).unionByName(closed), [F.col("slice") == 0, F.col("slice") == 1], place, table.follow)
    table.compact(1_000_000)
    table.table.vacuum()
    rows = table.current()
    return rows.select("signal_id", "status", q6(ledger.number(F.col("profit_pct"))).alias("profit_pct"), "exit_time", "blocked_reason")


@query(sql.LADDER.replace("FROM priced p, roles", "FROM (SELECT * FROM priced WHERE ts < TIMESTAMP '2024-01-20 12:00:00') p, roles") + f""", k AS (SELECT bars.*, least, row_number() OVER (PARTITION BY symbol, bars.tf ORDER BY ts DESC) AS rn FROM bars JOIN roles USING (tf)),
z AS (SELECT * FROM k QUALIFY rn BETWEEN 2 AND 100 AND count(*) FILTER (rn <= 100) OVER (PARTITION BY symbol, tf) >= least)
SELECT symbol, tf, ts, close FROM z WHERE ts >= TIMESTAMP '2024-01-19 00:00:00'""")
def candle_source(spark, sf_dir):
    """``scan_as_of`` out of the data source of candles: a partition a series, count and end as options, the start a filter that goes to the reader."""
    place = ledger.work_folder(spark)
    ticks = market.ticks(spark, sf_dir).where("ts < timestamp_ntz '2024-01-20 12:00:00'")
    market.ladder(ticks, sql.FIXTURE).write.partitionBy("symbol", "tf").parquet(f"{place}/candles")
    name = broker.register(spark, broker.FolderStore(f"{place}/candles"), config=sql.FIXTURE)
    candles = spark.read.format(name).option("count", 100).option("end", "2024-01-20 12:00:00").load()
    return market.since(candles, "2024-01-19 00:00:00").select(*KEYS, "close")


# messages


@query(sql.SCAN + """SELECT symbol, CASE WHEN struct_4h = 'bullish' THEN 'BUY' ELSE 'SELL' END AS direction, """ + ", ".join(sql.q6(c, n) for c, n in (("price", "entry"), ("stop_loss", "stop_loss"), ("take_profit", "take_profit"))) + """, CAST(score AS INTEGER) AS score,
 CASE WHEN struct_4h = 'bullish' THEN 'BUY' ELSE 'SELL' END || ' ' || symbol || ' taken on its score alone, without an analyst' || chr(10) || 'Entry ' || format('{:,.4f}', price) || ', stop ' || format('{:,.4f}', stop_loss) || ', target ' || format('{:,.4f}', take_profit) || chr(10) || 'Score ' || CAST(score AS INTEGER) || '%' AS message
FROM levels WHERE NOT skipped AND score >= 45 AND tier <> 'closed'""")
def direct_decision(spark, sf_dir):
    """The path without an analyst: what the scan fires becomes a trade and a message."""
    d = decisions.direct_decision(scan.mtf_scan(market.scan_candles(spark, sf_dir, sql.FIXTURE)))
    return _out(d, ["symbol", "direction"], ["entry", "stop_loss", "take_profit"], ["score", "message"])


@query(sql.SCAN + """SELECT symbol, 'Paper signal ' || symbol || '-1: ' || symbol || chr(10) || 'Score ' || CAST(score AS INTEGER) || '/100, quality N/A' || chr(10) || 'Entry ' || format('{:,.4f}', entry_low) || ' to ' || format('{:,.4f}', entry_high) || chr(10)
 || 'Target ' || format('{:,.4f}', take_profit) || ' (+' || format('{:,.2f}', tp_pct) || '%)' || chr(10) || 'Stop ' || format('{:,.4f}', stop_loss) || ' (-' || format('{:,.2f}', sl_pct) || '%)' || chr(10) || 'Reward to risk ' || format('{:,.2f}', rr_ratio) || chr(10)
 || 'Trend filter: TREND_OK' || chr(10) || 'Summary: ' || struct_4h || chr(10) || 'Main risk: N/A' || chr(10) || 'Contradictions: N/A' || chr(10) || 'Confidence: N/A' || chr(10) || 'RSI 1H N/A, 4H N/A' || chr(10) || 'MACD N/A, volume N/A times its mean' || chr(10) || 'Averages 1H N/A, 4H N/A' || chr(10) || 'Paper trade only, no real money' AS message
FROM levels WHERE NOT skipped""")
def signal_messages(spark, sf_dir):
    """The message of each scored signal; what the analyst or the display did not tell is N/A."""
    s = scan.mtf_scan(market.scan_candles(spark, sf_dir, sql.FIXTURE)).where("not skipped")
    s = s.select("symbol", "score", "entry_low", "entry_high", "take_profit", "tp_pct", "stop_loss", "sl_pct", "rr_ratio", F.concat("symbol", F.lit("-1")).alias("signal_id"), F.lit(None).cast("string").alias("signal_quality"), F.lit("TREND_OK").alias("trend_filter_result"), F.col("struct_4h").alias("plain_english_summary"))
    return reports.signal_message(s).select("symbol", "message")


_WHEN = "strftime(ts + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M')"


@query(f"SELECT event_id, 'Signal blocked: ' || event_type || chr(10) || 'Score: ' || event_id % 101 || '/100' || chr(10) || 'Reason: ' || CASE WHEN event_id % 3 = 0 THEN 'N/A' ELSE 'gate ' || event_id % 3 END || chr(10) || 'Time: ' || {_WHEN} AS message FROM events WHERE event_id % 5 = 0")
def block_messages(spark, sf_dir):
    """A message for every fifth event, as a signal that is blocked (fixture)."""
    k = F.col("event_id")
    e = market.table(spark, sf_dir, "events").where("event_id % 5 = 0").select("event_id", F.col("event_type").alias("symbol"), F.pmod(k, F.lit(101)).alias("score"), F.when(k % 3 != 0, F.concat(F.lit("gate "), (k % 3).cast("string"))).alias("blocked_reason"), "ts")
    return reports.block_message(e).select("event_id", "message")


@query(f"SELECT event_id, 'Error: ' || event_type || chr(10) || 'Message: ' || left(repeat(props, 60), 500) || chr(10) || 'Time: ' || {_WHEN} || chr(10) || 'Next action: ' || CASE WHEN event_id % 2 = 0 THEN 'try again' ELSE 'N/A' END AS message FROM events")
def alert_messages(spark, sf_dir):
    """Every event as an error to be told (fixture), its text cut at 500 characters."""
    e = market.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("error_type"), F.repeat("props", F.lit(60)).alias("error_message"), F.when(F.col("event_id") % 2 == 0, "try again").alias("recovery_action"), "ts")
    return reports.alert_message(e).select("event_id", "message")


@query(sql.LEDGER + """SELECT '<tr>' || '<td>' || 'XAUUSD' || '</td>' || '<td>' || CASE WHEN profit_pct > 0 THEN 'WIN' WHEN profit_pct < 0 THEN 'LOSS' ELSE 'OPEN' END || '</td>' || '<td>' || CASE WHEN coalesce(profit_pct, 0) < 0 THEN '-$' ELSE '+$' END || format('{:,.2f}', abs(coalesce(profit_pct, 0))) || '</td>' || '<td>' || strftime(timestamp, '%Y-%m-%d') || '</td>' || '</tr>' AS html
 FROM l ORDER BY timestamp DESC, signal_id DESC LIMIT 10""")
def html_rows(spark, sf_dir):
    """The dashboard's newest ten trades as rows of its table."""
    return reports.html_rows(reports.dashboard_rows(_ledger(spark, sf_dir), tie="signal_id").select("pair", "outcome", "pnl", "date"))


# long series, histories


_TEN = sql.PRICED + f""", bars AS (SELECT symbol, '10m' AS tf, time_bucket(INTERVAL 10 MINUTE, p.ts) AS ts, {sql._BAR} FROM priced p GROUP BY symbol, time_bucket(INTERVAL 10 MINUTE, p.ts)),
c AS (SELECT *, row_number() {sql.W} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars) """


def _ten(spark, sf_dir):
    """Ten-minute bars with their places, numbered over range partitions."""
    return chunks.placed(market.bars(market.ticks(spark, sf_dir), 10))


@query(_TEN + """, e AS (SELECT a.symbol, a.i, """ + ", ".join(f"round(sum(CASE WHEN b.i = 0 THEN b.close ELSE b.close * (2.0::DOUBLE / {n + 1}) END * pow({n - 1}.0::DOUBLE / {n + 1}, a.i - b.i)) * 1000) / 1000 AS ema{n}" for n in (20, 50)) + """ FROM c a JOIN c b ON b.symbol = a.symbol AND b.i <= a.i GROUP BY a.symbol, a.i)
SELECT c.symbol, c.ts, i, CASE WHEN i >= 19 THEN ema20 END AS ema20, CASE WHEN i >= 49 THEN ema50 END AS ema50, """ + sql.q6("CASE WHEN i >= 19 THEN avg(close) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) END", "ma20") + " FROM c JOIN e USING (symbol, i)")
def long_series_means(spark, sf_dir):
    """Means of series that are cut in chunks, each with as many rows before it as an exponential mean of 50 remembers."""
    before = chunks.fading(49 / 51)
    df = chunks.in_chunks(_ten(spark, sf_dir), lambda d: indicators.ema(indicators.moving_averages(d)), rows=1200, before=before)
    return df.select("symbol", "ts", "i", *[(F.round(F.col(c) * 1000) / 1000).alias(c) for c in ("ema20", "ema50")], q6(F.col("ma20")).alias("ma20"))


@query(_TEN + """, sw AS (SELECT *, i >= 3 AND i < n - 3 AND high > max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AND high > max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS sh FROM c),
fb AS (SELECT a.symbol, a.i AS from_i, a.high AS level, min(b.i) AS j FROM sw a JOIN sw b ON a.symbol = b.symbol AND b.i > a.i AND b.close > a.high WHERE a.sh GROUP BY ALL)
SELECT symbol, j AS bos_index, """ + sql.q6("level", "broken_level") + """, from_i AS swing_high_index FROM fb WHERE symbol IN (SELECT symbol FROM sw WHERE sh GROUP BY symbol HAVING count(*) >= 2) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY j DESC, from_i) = 1""")
def long_series_bos(spark, sf_dir):
    """The newest break of structure of long series: swings in chunks that overlap, first closes by a tree of maxima of two depths."""
    swung = chunks.in_chunks(_ten(spark, sf_dir), structure.swings, rows=1200, before=3, after=3)
    return _out(structure.bos_up(swung, depth=2), ["symbol"], ["broken_level"], ["bos_index", "swing_high_index"])


_HOURS = sql.BARS_1H + sql._INDEXED.format(w=sql.W, source="bars") + sql._SWINGS


@query(_HOURS + """, fb AS (SELECT p.symbol, p.i AS w, a.i AS from_i, a.high AS level, min(b.i) AS j FROM sw p JOIN sw a ON a.symbol = p.symbol AND a.sh AND a.i + a.k <= p.i JOIN sw b ON b.symbol = a.symbol AND b.i > a.i AND b.i <= p.i AND b.close > a.high GROUP BY ALL),
known AS (SELECT p.symbol, p.i AS w FROM sw p JOIN sw a ON a.symbol = p.symbol AND a.sh AND a.i + a.k <= p.i GROUP BY ALL HAVING count(*) >= 2)
SELECT symbol, w AS i, j AS bos_index, """ + sql.q6("level", "broken_level") + """, from_i AS swing_high_index FROM fb JOIN known USING (symbol, w) QUALIFY row_number() OVER (PARTITION BY symbol, w ORDER BY j DESC, from_i) = 1""")
def bos_history(spark, sf_dir):
    """The break of structure as it was known after each hourly bar; the SQL evaluates every prefix."""
    return _out(long_series.bos_history(structure.swings(_hourly(spark, sf_dir))), ["symbol", "i"], ["broken_level"], ["bos_index", "swing_high_index"])


@query(_HOURS + """, g AS (SELECT a.symbol, a.i, a.low, p.close - p.open AS body, p.high - p.low AS span, q.high AS flow, (a.low - q.high) / nullif(q.high, 0) AS size FROM sw a JOIN sw p ON p.symbol = a.symbol AND p.i = a.i - 1 JOIN sw q ON q.symbol = a.symbol AND q.i = a.i - 2),
ok AS (SELECT * FROM g WHERE body > 0 AND span <> 0 AND body / span >= 0.6::DOUBLE AND low > flow AND size >= 0.001::DOUBLE)
SELECT p.symbol, p.i, ok.i - 1 AS fvg_index, """ + sql.q6("round(ok.flow, 4)", "fvg_low") + ", " + sql.q6("round(ok.low, 4)", "fvg_high") + """ FROM sw p JOIN ok ON ok.symbol = p.symbol AND ok.i <= p.i AND ok.i > greatest(2, p.i + 1 - 50) AND NOT EXISTS (SELECT 1 FROM sw z WHERE z.symbol = p.symbol AND z.i BETWEEN ok.i AND p.i AND z.low < ok.flow)
QUALIFY row_number() OVER (PARTITION BY p.symbol, p.i ORDER BY ok.i DESC) = 1""")
def gap_history(spark, sf_dir):
    """The newest open gap as it was known after each hourly bar; the SQL evaluates every prefix."""
    return _out(long_series.gap_history(_hourly(spark, sf_dir)), ["symbol", "i"], ["fvg_low", "fvg_high"], ["fvg_index"])


@query(sql.LADDER + ", b AS (SELECT symbol, ts, ts + INTERVAL 15 MINUTE AS at FROM bars WHERE tf = '15M') SELECT b.symbol, b.ts, " + ", ".join(f"x{k}.close AS close_{t.lower()}" for k, (t, *_) in enumerate(sql.FIXTURE.roles)) + " FROM b " + " ".join(
    f"ASOF LEFT JOIN (SELECT symbol, ts + to_minutes({m}) AS e, close FROM bars WHERE tf = '{t}') x{k} ON x{k}.symbol = b.symbol AND b.at >= x{k}.e" for k, (t, m, *_) in enumerate(sql.FIXTURE.roles)))
def timeframes_aligned(spark, sf_dir):
    """Every 15-minute bar with the closes of all timeframes that were known at its end; the SQL has an as-of join for each."""
    bars = market.ladder(market.ticks(spark, sf_dir), sql.FIXTURE)
    return long_series.aligned(bars, bars, {t: m for t, m, _, _ in sql.FIXTURE.roles}, "close", "15M")


@query(sql.BARS_1H + "SELECT count(*) AS bars, count(*) AS times, true AS within, true AS features FROM bars WHERE symbol = 'ALL'")
def synthetic_ohlcv(spark, sf_dir):
    """The generator makes as many bars as the events have hours, within their prices, and the gold features can be taken from them."""
    given = market.bars(market.ticks(spark, sf_dir), 60, "1H").where("symbol = 'ALL'").agg(F.count("*").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    candles = market.synthetic_candles(spark, bars=given["n"], low=given["low"], high=given["high"])
    within = F.min(F.least(*[F.col(c) for c in OHLCV[:4]]) >= given["low"]) & (F.max(F.greatest(*[F.col(c) for c in OHLCV[:4]])) <= given["high"]) & (F.min("volume") >= 1000) & (F.max("volume") <= 5000)
    feats = indicators.filled(indicators.gold_features(candles), indicators.GOLD_FEATURES)
    ready = F.min(F.least(*[F.col(c).isNotNull().cast("int") for c in indicators.GOLD_FEATURES])) == 1
    return feats.agg(F.count("*").alias("bars"), F.countDistinct("ts").alias("times"), within.alias("within"), ready.alias("features"))


@query()
def risk_admission(spark, sf_dir):
    """Which orders each account takes when gates count admitted trades only; a decision hangs on all before it, so there is no SQL."""
    orders = market.table(spark, sf_dir, "orders")
    rows = ledger.from_orders(orders).join(orders.select(F.col("o_orderkey").alias("signal_id"), F.pmod("o_custkey", F.lit(97)).alias("account")), "signal_id")
    return admission.admitted(rows.withColumn("rr_ratio", 1.5 + F.pmod("signal_id", F.lit(5)) / 4.0), replace(DEFAULT, max_open=3, block_hours=(21, 22)))


_CUTS = ["2024-01-12", "2024-01-18", "2024-01-24"]
_LABELS = sql.TRADES.replace("(SELECT *, CASE WHEN (i + 1) % 8 = 0 THEN 0.0002::DOUBLE ELSE 0.004::DOUBLE END AS w FROM c WHERE (i + 1) % 4 = 0)", "(SELECT *, 0.004::DOUBLE AS w FROM c)") + """, lb AS (SELECT r.signal_id, t.symbol, t.entry_ts AS ts, CAST(r.status = 'WIN' AS INTEGER) AS label, t.entry_ts + INTERVAL 48 HOUR AS known_ts FROM replay r JOIN tr t USING (signal_id) WHERE r.status <> 'OPEN') """


@query(_LABELS + "SELECT count(*) AS rows, CAST(sum(label) AS BIGINT) AS won, true AS learns, true AS importances, true AS same_after_reload FROM lb")
def model_properties(spark, sf_dir):
    """A model fitted on the labelled bars: that it is better than the commoner label, its importances, and that a saved model scores alike."""
    bars, place = market.bars(market.ticks(spark, sf_dir), 60, "1H"), ledger.work_folder(spark)
    indicators.filled(indicators.gold_features(bars), indicators.GOLD_FEATURES).join(ml.barrier_labels(bars), ["symbol", "ts"]).write.parquet(f"{place}/rows")
    rows = spark.read.parquet(f"{place}/rows")
    model = ml.fit(rows, trees=10)
    ml.save(model, f"{place}/model")
    a, b = (ml.score(m, rows).select("symbol", "ts", F.round("ml_confidence", 9).alias(c)) for m, c in ((model, "a"), (ml.load(f"{place}/model"), "b")))
    same = a.join(b, ["symbol", "ts"]).agg(F.count_if(F.col("a") != F.col("b")) == 0).first()[0]
    weight = ml.feature_importance(model, spark).agg((F.abs(F.sum("importance") - 1) < 1e-6) & (F.count("*") == len(indicators.GOLD_FEATURES))).first()[0]
    share = F.avg(F.col("label").cast("double"))
    commoner = rows.agg(F.greatest(share, 1 - share)).first()[0]
    return rows.agg(F.count("*").alias("rows"), F.sum("label").alias("won"), F.lit(bool(ml.accuracy(model, rows) >= commoner)).alias("learns"), F.lit(weight).alias("importances"), F.lit(same).alias("same_after_reload"))


@query(_LABELS + "SELECT symbol, ts, label, known_ts FROM lb")
def barrier_labels(spark, sf_dir):
    """Every hourly bar with whether a trade from it would have won."""
    return ml.barrier_labels(market.bars(market.ticks(spark, sf_dir), 60, "1H"))


@query(_LABELS + ", f(fold, a, b) AS (VALUES " + ", ".join(f"({k}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for k, (a, b) in enumerate(zip(_CUTS, [*_CUTS[1:], "9999-01-01"], strict=True))) + """)
SELECT fold, CASE WHEN ts >= a THEN 'test' ELSE 'train' END AS role, symbol, count(*) AS bars, CAST(sum(label) AS BIGINT) AS won, max(known_ts) AS last_known FROM lb, f WHERE (ts >= a AND ts < b) OR known_ts + INTERVAL 6 HOUR < a GROUP BY ALL""")
def walk_forward_splits(spark, sf_dir):
    """Folds of the labelled bars: what is trained on was known six hours before what is tested."""
    rows = ml.walk_forward(ml.barrier_labels(market.bars(market.ticks(spark, sf_dir), 60, "1H")), _CUTS, gap_hours=6)
    return rows.groupBy("fold", "role", "symbol").agg(F.count("*").alias("bars"), F.sum("label").alias("won"), F.max("known_ts").alias("last_known"))


@query()
def walk_forward_auc(spark, sf_dir):
    """Area under the curve of each fold's held-out bars, by trees fitted on labels known before them."""
    bars, place = market.bars(market.ticks(spark, sf_dir), 60, "1H"), ledger.work_folder(spark)
    feats = indicators.filled(indicators.gold_features(bars), indicators.GOLD_FEATURES).join(ml.barrier_labels(bars), ["symbol", "ts"])
    ml.walk_forward(feats, _CUTS, gap_hours=6).write.parquet(f"{place}/folds")
    told = ml.held_out_auc(spark.read.parquet(f"{place}/folds"), len(_CUTS))
    return spark.createDataFrame(told, "fold int, trained long, tested long, auc double")


@query()
def gbt_score(spark, sf_dir):
    """Scores of the newest hourly bars by a model fitted on the synthetic set."""
    model = ml.fit(ml.synthetic_training(spark, 1000))
    feats = indicators.filled(indicators.gold_features(market.bars(market.ticks(spark, sf_dir), 60, "1H")), indicators.GOLD_FEATURES)
    return ml.score(model, feats.where("i = n - 1")).select("symbol", "ts", "ml_confidence")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of all symbols and timeframes."""
    return mtf_scan(spark, sf_dir)
