"""Sessions, liquidity tiers, killzones and the news guard as column expressions of an event time (UTC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.config import DEFAULT, Config

#: Per tier the size multiplier, confidence gate, stop width and description.
TIERS = {
    "peak": (1.0, "WEAK", 0.9, "both western markets open"),
    "high": (0.9, "MODERATE", 1.0, "one western market open"),
    "secondary": (0.6, "STRONG", 1.2, "eastern hours, few orders"),
    "closed": (0.0, "STRONG", 1.5, "no market open"),
}
RANKS = {"STRONG": 3, "MODERATE": 2, "WEAK": 1}


def lookup(values: dict, key: Column, default: object) -> Column:
    """The dictionary's value for *key*, or the default."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key), F.lit(default))


def market_open(ts: Column) -> Column:
    return F.weekday(ts) < 5


def session(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when((h >= 20) | (h < 8), "asia").when(h < 17, "london").otherwise("ny")


def tier(ts: Column) -> Column:
    day, h, m = F.weekday(ts), F.hour(ts), F.minute(ts)
    half = h * 60 + m
    return (
        F.when((day >= 5) | ((day == 4) & (h >= 21)), "closed")
        .when((half >= 13 * 60) & (half < 16 * 60 + 30), "peak")
        .when((half >= 8 * 60) & (half < 20 * 60), "high")
        .otherwise("secondary")
    )


def size_multiplier(t: Column) -> Column:
    return lookup({k: v[0] for k, v in TIERS.items()}, t, 0.0)


def confidence_gate(t: Column) -> Column:
    return lookup({k: v[1] for k, v in TIERS.items()}, t, "STRONG")


def stop_width(atr: Column, t: Column) -> Column:
    return atr * lookup({k: v[2] for k, v in TIERS.items()}, t, 1.0)


def can_trade(quality: Column, gate: Column) -> Column:
    return lookup(RANKS, quality, 0) >= lookup(RANKS, gate, 3)


def description(t: Column) -> Column:
    return lookup({k: v[3] for k, v in TIERS.items()}, t, "unknown tier")


def killzone(ts: Column, config: Config = DEFAULT) -> Column:
    """The killzone's name, null outside."""
    out = F.lit(None).cast("string")
    for name, a, b in reversed(config.killzones):
        out = F.when((F.hour(ts) >= a) & (F.hour(ts) < b), name).otherwise(out)
    return out


def killzone_reason(ts: Column, config: Config = DEFAULT) -> Column:
    out = F.concat(F.lit("hour "), F.hour(ts).cast("string"), F.lit(" UTC is in no killzone"))
    for name, a, b in reversed(config.killzones):
        out = F.when((F.hour(ts) >= a) & (F.hour(ts) < b), f"{name}, {a} to {b} UTC").otherwise(out)
    return out


def news_guard(ts: Column, config: Config = DEFAULT) -> Column:
    """Why trading is blocked at ts, null if it is clear; the first reason in order counts.

    The calendars are two dozen days each, so they are values of the expression.
    """
    day, h = F.weekday(ts), F.hour(ts)
    date = F.date_format(ts, "yyyy-MM-dd")
    second = h * 3600 + F.minute(ts) * 60 + F.second(ts)
    exact = F.date_trunc("second", ts) == ts
    jobs = (day == 4) & (F.dayofmonth(ts) <= 7) & (second >= 13 * 3600 + 25 * 60) & ((second < 14 * 3600 + 5 * 60) | ((second == 14 * 3600 + 5 * 60) & exact))
    return (
        F.when(day == 5, "weekend")
        .when((day == 4) & (h >= 21), "friday_close")
        .when((day == 6) & (h < 22), "sunday_before_open")
        .when(jobs, "jobs_report")
        .when(date.isin(*config.rate_days) & (h >= 17) & (h < 22), "rate_statement")
        .when(date.isin(*config.price_days) & (h >= 13) & (h < 15), "price_release")
    )


def session_info(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add hour, minute, session, tier, market_open, size_multiplier, confidence_gate, is_trading_allowed, session_text."""
    t = F.col(ts)
    df = df.withColumn("utc_hour", F.hour(t)).withColumn("utc_minute", F.minute(t)).withColumn("session", session(t)).withColumn("tier", tier(t)).withColumn("market_open", market_open(t))
    return df.withColumn("size_multiplier", size_multiplier(F.col("tier"))).withColumn("confidence_gate", confidence_gate(F.col("tier"))).withColumn("is_trading_allowed", F.col("tier") != "closed").withColumn("session_text", description(F.col("tier")))


def local_text(ts: Column, config: Config = DEFAULT) -> Column:
    """The time in the display zone, as text."""
    return F.date_format(F.from_utc_timestamp(ts.cast("timestamp"), config.timezone), "yyyy-MM-dd HH:mm")


def parse_iso(text: Column) -> Column:
    """ISO text to UTC time without zone; Z and missing zones count as UTC, other text is null."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")).cast("timestamp_ntz")


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms).cast("timestamp_ntz")
