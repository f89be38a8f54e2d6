"""Messages, dashboard rows and sizing as column expressions; sending them is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import DEFAULT, Config
from tickloom.operators.ledger import best_worst, clean_target, money, pnl_column, profit_factor, quality_counts, running_stats
from tickloom.operators.sessions import local_text


def _text(c: Column | str, default: str = "N/A") -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(default))


def _lines(*parts: Column) -> Column:
    """Lines of text; null ones are left out."""
    return F.concat_ws("\n", *parts)


def signal_message(df: DataFrame) -> DataFrame:
    """Add message: a scored signal with its levels, the analyst's words and the indicators; what is absent or null is N/A."""
    have = set(df.columns)
    of = lambda c: _text(c) if c in have else F.lit("N/A")
    crossed = F.when(F.col("crossover_1h"), "crossed up").otherwise("no cross") if "crossover_1h" in have else F.lit("N/A")
    shown = lambda c, n=4: F.format_number(c, n)
    return df.withColumn("message", _lines(
        F.concat(F.lit("Paper signal "), _text("signal_id"), F.lit(": "), _text("symbol")),
        F.concat(F.lit("Score "), _text("score"), F.lit("/100, quality "), _text("signal_quality")),
        F.concat(F.lit("Entry "), shown("entry_low"), F.lit(" to "), shown("entry_high")),
        F.concat(F.lit("Target "), shown("take_profit"), F.lit(" (+"), shown("tp_pct", 2), F.lit("%)")),
        F.concat(F.lit("Stop "), shown("stop_loss"), F.lit(" (-"), shown("sl_pct", 2), F.lit("%)")),
        F.concat(F.lit("Reward to risk "), shown("rr_ratio", 2)),
        F.concat(F.lit("Trend filter: "), of("trend_filter_result")),
        F.concat(F.lit("Summary: "), of("plain_english_summary")),
        F.concat(F.lit("Main risk: "), of("main_risk")),
        F.concat(F.lit("Contradictions: "), of("any_contradictions")),
        F.concat(F.lit("Confidence: "), of("confidence_note")),
        F.concat(F.lit("RSI 1H "), of("rsi_1h"), F.lit(", 4H "), of("rsi_4h")),
        F.concat(F.lit("MACD "), crossed, F.lit(", volume "), of("volume_ratio"), F.lit(" times its mean")),
        F.concat(F.lit("Averages 1H "), of("ema_status_1h"), F.lit(", 4H "), of("ema_status_4h")),
        F.lit("Paper trade only, no real money"),
    ))


def block_message(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Add message: a blocked signal with its score, reason and local time."""
    return df.withColumn("message", _lines(F.concat(F.lit("Signal blocked: "), _text("symbol")), F.concat(F.lit("Score: "), _text("score"), F.lit("/100")), F.concat(F.lit("Reason: "), _text("blocked_reason")), F.concat(F.lit("Time: "), local_text(F.col("ts"), config))))


def alert_message(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Add message from error_type, error_message (500 characters) and recovery_action."""
    return df.withColumn("message", _lines(F.concat(F.lit("Error: "), _text("error_type")), F.concat(F.lit("Message: "), F.substring(_text("error_message", ""), 1, 500)), F.concat(F.lit("Time: "), local_text(F.col("ts"), config)), F.concat(F.lit("Next action: "), _text("recovery_action"))))


def scan_summary(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Add message, null for a quiet scan outside the day's first local hour."""
    quiet = (F.col("signals_logged") == 0) & (F.col("signals_blocked") == 0)
    first = F.hour(F.from_utc_timestamp(F.col("ts").cast("timestamp"), config.timezone)) == 0
    status = F.when(quiet, "No signals today so far").when(F.col("signals_logged") > 0, "Signals found").otherwise("Signals blocked by risk rules")
    text = _lines(
        F.concat(F.lit("Scan complete, "), local_text(F.col("ts"), config)), status,
        F.concat(F.lit("Scanned: "), _text("scanned")),
        F.concat(F.lit("Shortlisted: "), _text("shortlisted"), F.lit(", logged: "), _text("signals_logged"), F.lit(", blocked: "), _text("signals_blocked")),
        F.concat(F.lit("Open paper trades: "), _text("open_trades"), F.lit("/15")),
    )
    return df.withColumn("message", F.when(~quiet | first, text))


def report_stats(ledger: DataFrame, by: str = "system") -> DataFrame:
    """Running statistics with profit factor, best and worst trade, quality counts and days since the first signal: a row per system."""
    days = ledger.groupBy(by).agg((F.datediff(F.max("timestamp"), F.min("timestamp")) + 1).alias("days_running"))
    out = running_stats(ledger, by)
    for part in (profit_factor(ledger, by), best_worst(ledger, by), quality_counts(ledger, by), days):
        out = out.join(part, by)
    return out


def daily_report(stats: DataFrame) -> DataFrame:
    """Add message to ``report_stats``; scanned, passed and blocked are the day's, where *stats* has them."""
    have = set(stats.columns)
    signed = lambda c: F.concat(F.when(F.col(c) >= 0, "+").otherwise(""), F.format_number(c, 2), F.lit("%"))
    day = [F.concat(F.lit("Scanned: "), _text("scanned"), F.lit(", passed: "), _text("passed"), F.lit(", blocked: "), _text("blocked"))] if {"scanned", "passed", "blocked"} <= have else []
    factor = F.when(F.col("profit_factor") == float("inf"), "∞").otherwise(F.format_number("profit_factor", 2))
    best = lambda w: F.when(F.col(f"{w}_id").isNull(), "none").otherwise(F.concat(_text(f"{w}_id"), F.lit(" "), signed(f"{w}_pct")))
    return stats.withColumn("message", _lines(
        F.concat(F.lit("Days running: "), _text("days_running")), *day,
        F.concat(F.lit("Open trades: "), _text("total_open"), F.lit("/15")),
        F.concat(F.lit("Wins: "), _text("total_wins"), F.lit(", losses: "), _text("total_losses"), F.lit(", expired: "), _text("total_expired")),
        F.concat(F.lit("Win rate: "), F.format_number("win_rate", 1), F.lit("%")),
        F.concat(F.lit("Cumulative result: "), F.when(F.col("total_pnl") > 0, "+").otherwise(""), F.format_number("total_pnl", 2), F.lit("%")),
        F.concat(F.lit("Profit factor: "), factor),
        F.concat(F.lit("Best: "), best("best"), F.lit(", worst: "), best("worst")),
        F.concat(F.lit("Strong: "), _text("strong_count"), F.lit(", moderate: "), _text("moderate_count"), F.lit(", weak: "), _text("weak_count")),
        F.concat(F.lit("Trend filter passed: "), _text("trend_passed"), F.lit(", blocked: "), _text("trend_blocked")),
    ))


def dashboard_rows(ledger: DataFrame, n: int = 10, order: str = "timestamp", tie: str | None = None) -> DataFrame:
    """The newest n trades as (pair, direction, entry, stop_loss, target, outcome, pnl, date), columns by fallback."""
    have = set(ledger.columns)
    of = lambda names, default: next((_text(c, default) for c in names if c in have), F.lit(default))
    p = F.coalesce(F.col(pnl_column(ledger)).try_cast("double"), F.lit(0.0))
    newest = [F.col(order).desc_nulls_last(), *([F.col(tie).desc()] if tie else [])]
    shown = lambda c: F.replace(c, F.lit("?"), F.lit("N/A"))
    return ledger.orderBy(*newest).limit(n).select(
        of(("pair", "symbol"), "XAUUSD").alias("pair"), of(("direction",), "?").alias("direction"), shown(of(("entry", "entry_price"), "?")).alias("entry"), shown(of(("stop_loss", "sl"), "?")).alias("stop_loss"),
        shown(clean_target(of(("take_profits", "take_profit"), "?"))).alias("target"), F.when(p > 0, "WIN").when(p < 0, "LOSS").otherwise("OPEN").alias("outcome"), money(p).alias("pnl"), F.substring(_text(order, ""), 1, 10).alias("date"),
    )


def html_rows(rows: DataFrame) -> DataFrame:
    """(html): one table row per dashboard row, values escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return rows.select(F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in rows.columns], F.lit("</tr>")).alias("html"))


def comparison(metrics: DataFrame, by: str = "system") -> DataFrame:
    """One row with both systems' figures side by side, by conditional aggregation."""
    cols = [c for c in ("trades", "wins", "losses", "win_rate", "pnl", "profit_factor") if c in metrics.columns]
    return metrics.agg(*[F.max(F.when(F.col(by) == s, F.col(c))).alias(f"{c}_{s.lower()}") for s in ("A", "C") for c in cols])


def position_size(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Add kelly (capped, 0 at least) and size: base by tier multiplier and by win rate (below 40 %: half, above 60 %: one and a half)."""
    edge = F.col("win_rate") / 100 - (1 - F.col("win_rate") / 100) / F.nullif("rr_ratio", F.lit(0.0))
    factor = F.when(F.col("win_rate") < 40, config.size_factors[0]).when(F.col("win_rate") > 60, config.size_factors[2]).otherwise(config.size_factors[1])
    return df.withColumn("kelly", F.least(F.greatest(F.coalesce(edge, F.lit(0.0)), F.lit(0.0)), F.lit(config.kelly_cap))).withColumn("size", F.lit(config.base_size) * F.col("size_multiplier") * factor)


def loss_caps(ledger: DataFrame, config: Config = DEFAULT, by: str = "system") -> DataFrame:
    """Per system and day: the day's and its week's result so far, and whether trading stops."""
    daily = ledger.groupBy(by, F.to_date("timestamp").alias("day")).agg(F.coalesce(F.sum("profit_pct"), F.lit(0.0)).alias("day_pnl"))
    week = Window.partitionBy(by, F.date_trunc("week", "day")).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("week_pnl", F.sum("day_pnl").over(week)).withColumn("stopped", (F.col("day_pnl") <= config.day_loss_cap) | (F.col("week_pnl") <= config.week_loss_cap))
