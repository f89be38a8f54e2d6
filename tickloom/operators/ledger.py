"""The trade ledger: sources and sinks, outcome resolution, performance figures."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.config import DEFAULT, Config

#: Columns of the paper ledger (all text) and of the live one.
LEDGER_A = (
    "signal_id", "timestamp", "symbol", "direction", "score", "signal_quality", "entry_price", "entry_low", "entry_high", "stop_loss", "take_profit", "rr_ratio",
    "trend_filter_result", "plain_english_summary", "main_risk", "any_contradictions", "status", "exit_price", "exit_time", "result", "profit_pct", "exit_reason", "blocked_reason",
)
LEDGER_C = ("timestamp", "pair", "direction", "entry", "stop_loss", "take_profits", "pnl", "signal_source", "ml_confidence", "claude_confidence", "combined_confidence")


def text_schema(names: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in names])


def work_folder(spark: SparkSession) -> str:
    """A new folder for ledgers and streams, in the one the session shares (``spark.checkpoint.dir``); a temporary one on a single machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return f"{shared.rstrip('/')}/ledger-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="ledger-")


def read_ledger(spark: SparkSession, path: str, columns: tuple[str, ...] = LEDGER_A) -> DataFrame:
    """A ledger as text columns in fixed order, by the file's header; a missing file is an empty ledger, missing columns are empty."""
    try:
        raw = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", True).option("escape", '"').csv(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], text_schema(columns))
    return raw.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if c in raw.columns else F.lit("").alias(c) for c in columns])


def write_ledger(ledger: DataFrame, path: str) -> None:
    """A new version of the ledger; never the path it was read from."""
    ledger.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).option("escape", '"').csv(path)


def log_signals(ledger: DataFrame, signals: DataFrame) -> DataFrame:
    """The ledger with signals appended: status BLOCKED where blocked_reason is given, else OPEN; ids by hash of the row."""
    known = set(signals.columns)
    sid = F.upper(F.substring(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in ("symbol", "timestamp", "direction", "entry_price") if c in known]), 256), 1, 8))
    blocked = F.coalesce(F.col("blocked_reason"), F.lit("")) if "blocked_reason" in known else F.lit("")
    rows = signals.withColumn("signal_id", sid).withColumn("blocked_reason", blocked).withColumn("status", F.when(blocked != "", "BLOCKED").otherwise("OPEN"))
    rows = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in LEDGER_A])
    return ledger.unionByName(rows, allowMissingColumns=True)


def number(c: Column) -> Column:
    """Text to double; what is no number is null."""
    return c.try_cast("double")


def pnl_column(df: DataFrame) -> str:
    return "pnl" if "pnl" in df.columns else "profit_pct"


def from_orders(orders: DataFrame) -> DataFrame:
    """A typed ledger made from the orders table (fixture): outcome and status by rules on the key."""
    key = F.col("o_orderkey")
    closed = F.col("o_orderstatus") == "F"
    pct = F.when(closed, (F.pmod(key * 7919, F.lit(401)) - 200) / 100.0)
    return orders.select(
        key.alias("signal_id"), F.col("o_orderdate").alias("timestamp"), F.lit("XAUUSD").alias("symbol"),
        F.when(closed, F.when(pct > 0, "WIN").when(pct < 0, "LOSS").otherwise("EXPIRED")).alias("result"),
        F.when(closed, "CLOSED").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("BLOCKED").alias("status"),
        pct.alias("profit_pct"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "STRONG").when(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), "MODERATE").otherwise("WEAK").alias("signal_quality"),
        F.when(closed, F.col("o_orderdate") + F.make_dt_interval(hours=F.pmod(key, F.lit(48)).cast("int"))).alias("exit_time"),
        F.when(key % 2 == 0, "A").otherwise("C").alias("system"),
        F.when(key % 3 == 0, "BLOCKED_TREND").otherwise("TREND_OK").alias("trend_filter_result"),
        (F.lit(2400.0) + F.pmod(key, F.lit(100)) / 10.0).alias("entry_price"),
        (F.lit(2400.0) + F.pmod(key, F.lit(100)) / 10.0 + F.when(key % 4 == 0, 5.0).otherwise(-5.0)).alias("stop_loss"),
        F.concat(F.lit("summary of trade "), key.cast("string")).alias("summary"),
    )


def dashboard_metrics(ledger: DataFrame, by: str = "system", config: Config = DEFAULT) -> DataFrame:
    """Per system: trades, wins, losses, win_rate over all rows, pnl, capital, return_pct, profit_factor (losses none: divisor 1; 0 of 0)."""
    p = F.coalesce(F.col(pnl_column(ledger)).try_cast("double"), F.lit(0.0))
    won, lost = F.sum(F.when(p > 0, p).otherwise(0.0)), F.sum(F.when(p < 0, p).otherwise(0.0))
    out = ledger.groupBy(by).agg(F.count("*").alias("trades"), F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.sum(p).alias("pnl"), won.alias("won"), lost.alias("lost"))
    divisor = F.when(F.col("losses") > 0, F.abs("lost")).otherwise(1.0)
    return out.select(
        by, "trades", "wins", "losses", (F.col("wins") * 100.0 / F.nullif("trades", F.lit(0))).alias("win_rate"), "pnl",
        (F.lit(config.start_capital) + F.col("pnl")).alias("capital"), (F.col("pnl") / config.start_capital * 100).alias("return_pct"),
        F.coalesce(F.col("won") / F.nullif(divisor, F.lit(0.0)), F.lit(0.0)).alias("profit_factor"),
    )


def daily_metrics(ledger: DataFrame, by: str = "system") -> DataFrame:
    """Per system, blocked trades of system A left out: trades, wins, losses, pnl, win_rate."""
    p = F.col(pnl_column(ledger)).try_cast("double")
    # a ledger without a status has no blocked trades
    blocked = F.coalesce(F.col("status") == "BLOCKED", F.lit(False)) if "status" in ledger.columns else F.lit(False)
    rows = ledger.where(~((F.col(by) == "A") & blocked))
    out = rows.groupBy(by).agg(F.count("*").alias("trades"), F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.coalesce(F.sum(p), F.lit(0.0)).alias("pnl"))
    return out.withColumn("win_rate", F.coalesce(F.col("wins") * 100.0 / F.nullif("trades", F.lit(0)), F.lit(0.0)))


def profit_factor(ledger: DataFrame, by: str | None = None) -> DataFrame:
    """Sum of WIN over the absolute sum of LOSS by result label, infinite without losses, two digits."""
    p, r = F.col("profit_pct").try_cast("double"), F.col("result")
    won, lost = F.coalesce(F.sum(F.when(r == "WIN", p)), F.lit(0.0)), F.abs(F.coalesce(F.sum(F.when(r == "LOSS", p)), F.lit(0.0)))
    value = F.when(lost == 0, F.lit(float("inf"))).otherwise(F.round(won / F.nullif(lost, F.lit(0.0)), 2)).alias("profit_factor")
    return ledger.groupBy(*([by] if by else [])).agg(value)


def running_stats(ledger: DataFrame, by: str = "system") -> DataFrame:
    """Counts by status and result, win_rate (one digit), averages and total of closed trades (two), in one aggregation."""
    p, r, s = F.col("profit_pct").try_cast("double"), F.col("result"), F.col("status")
    not_blocked = F.coalesce(s != "BLOCKED", F.lit(True))
    closed = r.isin("WIN", "LOSS", "EXPIRED")
    out = ledger.groupBy(by).agg(
        F.count_if(not_blocked).alias("total_signals"), F.count_if(s == "BLOCKED").alias("total_blocked"), F.count_if(s == "OPEN").alias("total_open"),
        F.count_if(r == "WIN").alias("total_wins"), F.count_if(r == "LOSS").alias("total_losses"), F.count_if(r == "EXPIRED").alias("total_expired"),
        F.avg(F.when(r == "WIN", p)).alias("avg_win_pct"), F.avg(F.when(r == "LOSS", p)).alias("avg_loss_pct"), F.sum(F.when(closed, p)).alias("total_pnl"),
        F.count_if(F.col("trend_filter_result").startswith("TREND_OK")).alias("trend_passed"), F.count_if(F.col("trend_filter_result").startswith("BLOCKED")).alias("trend_blocked"),
    )
    played = F.col("total_wins") + F.col("total_losses")
    out = out.withColumn("win_rate", F.coalesce(F.col("total_wins") * 100.0 / F.nullif(played, F.lit(0)), F.lit(0.0)))
    return out.withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), n) for c, n in (("win_rate", 1), ("avg_win_pct", 2), ("avg_loss_pct", 2), ("total_pnl", 2))})


def streaks(ledger: DataFrame, by: str = "system") -> DataFrame:
    """Wins or losses in a row up to the newest closed trade; an expired one ends the count.

    The newest trade of another kind than the newest of all is found by two
    maxima; the streak is what stands after it.  Ties in time go by id.
    """
    closed = ledger.where(F.col("result").isin("WIN", "LOSS", "EXPIRED"))
    at = F.struct("exit_time", "signal_id")
    last = closed.groupBy(by).agg(F.max_by("result", at).alias("kind"))
    both = closed.join(last, by)
    stop = both.groupBy(by).agg(F.max(F.when(F.col("result") != F.col("kind"), at)).alias("stop"))
    run = both.join(stop, by).where(F.col("stop").isNull() | (at > F.col("stop"))).groupBy(by, "kind").agg(F.count("*").alias("k"))
    return run.select(by, F.when(F.col("kind") == "WIN", F.col("k")).otherwise(0).alias("consecutive_wins"), F.when(F.col("kind") == "LOSS", F.col("k")).otherwise(0).alias("consecutive_losses"))


def best_worst(ledger: DataFrame, by: str = "system") -> DataFrame:
    """The best WIN and the worst LOSS by percentage; the first id on ties, unknown percentages are left out."""
    p, r = F.col("profit_pct").try_cast("double"), F.col("result")
    # ids may be numbers or text
    best = F.when((r == "WIN") & p.isNotNull(), F.struct((-p).alias("p"), F.col("signal_id").alias("s")))
    worst = F.when((r == "LOSS") & p.isNotNull(), F.struct(p.alias("p"), F.col("signal_id").alias("s")))
    return ledger.groupBy(by).agg(F.min(best).alias("b"), F.min(worst).alias("w")).select(by, F.col("b.s").alias("best_id"), (-F.col("b.p")).alias("best_pct"), F.col("w.s").alias("worst_id"), F.col("w.p").alias("worst_pct"))


def quality_histogram(ledger: DataFrame) -> DataFrame:
    """Trades that are not blocked by signal_quality, unknown quality left out."""
    return ledger.where(F.coalesce(F.col("status") != "BLOCKED", F.lit(True)) & F.col("signal_quality").isNotNull()).groupBy("signal_quality").agg(F.count("*").alias("n"))


def quality_counts(ledger: DataFrame, by: str = "system") -> DataFrame:
    """Per system the trades that are not blocked, strong, moderate and weak ones; 0 where there is none."""
    kept, q = F.coalesce(F.col("status") != "BLOCKED", F.lit(True)), F.col("signal_quality")
    return ledger.groupBy(by).agg(*[F.count_if(kept & (q == v)).alias(f"{v.lower()}_count") for v in ("STRONG", "MODERATE", "WEAK")])


def of_symbol(ledger: DataFrame, part: str, column: str = "symbol") -> DataFrame:
    """Rows whose symbol contains *part*, whatever the broker adds to it; unknown symbols do not."""
    return ledger.where(F.coalesce(F.col(column).contains(part), F.lit(False)))


def equity_curve(ledger: DataFrame, by: str = "system", last: int = 50, config: Config = DEFAULT) -> DataFrame:
    """The last points of capital plus the running sum of results, in order of id.

    Only the newest *last* rows per system are sorted by a window; what came
    before them is one sum.
    """
    p = F.coalesce(F.col(pnl_column(ledger)).try_cast("double"), F.lit(0.0))
    newest = Window.partitionBy(by).orderBy(F.col("signal_id").desc())
    rows = ledger.select(by, "signal_id", p.alias("p"))
    tail = rows.withColumn("__rn", F.row_number().over(newest)).where(F.col("__rn") <= last)
    total = rows.groupBy(by).agg(F.sum("p").alias("__all"))
    after = F.coalesce(F.sum("p").over(newest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return tail.join(total, by).select(by, "signal_id", (F.lit(config.start_capital) + F.col("__all") - after).alias("equity"))


def recent_closed(ledger: DataFrame, n: int = 5) -> DataFrame:
    """The n newest closed trades, with date, direction as the stop tells it, and a summary of 200 characters."""
    return (
        ledger.where(F.col("result").isin("WIN", "LOSS", "EXPIRED"))
        .orderBy(F.col("exit_time").desc(), F.col("signal_id").desc())
        .limit(n)
        .select("signal_id", F.date_format("timestamp", "yyyy-MM-dd").alias("date"), F.when(F.col("stop_loss") > F.col("entry_price"), "SHORT").otherwise("LONG").alias("direction"), "entry_price", "stop_loss", "signal_quality", "result", "profit_pct", F.substring("summary", 1, 200).alias("summary"))
    )


def daily_count(ledger: DataFrame) -> DataFrame:
    """Signals per day that are not blocked."""
    return ledger.where(F.coalesce(F.col("status") != "BLOCKED", F.lit(True))).groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("signals"))


def closed_trades(ledger: DataFrame) -> DataFrame:
    """Rows whose result is not 0; an unknown result passes, as it is not equal to 0."""
    return ledger.where(F.coalesce(F.col(pnl_column(ledger)).try_cast("double") != 0, F.lit(True)))


def clean_target(text: Column) -> Column:
    """A target price out of its printed form; N/A where there is none."""
    wrapped = text.contains("np.float64") | text.contains("np.float32") | text.contains("[")
    inside = F.nullif(F.regexp_extract(text, r"\((\d+\.?\d*)\)", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(text, r"(\d{4,}\.\d+)", 1), F.lit(""))
    return F.when(wrapped, F.coalesce(inside, plain, F.lit("N/A"))).otherwise(text)


def profit_pct(result: Column, entry: Column, stop: Column, target: Column, exit_price: Column) -> Column:
    """Percentage of the entry price, four digits: to the target of a WIN, the stop of a LOSS, else the exit."""
    to = F.when(result == "WIN", target).when(result == "LOSS", stop).otherwise(exit_price)
    return F.round((to - entry) / F.nullif(entry, F.lit(0.0)) * 100, 4)


def _watched(trades: DataFrame, candles: DataFrame) -> DataFrame:
    """The trades once for each day from their entry to until, at most to the symbol's newest candle."""
    newest = candles.groupBy("symbol").agg(F.max(F.to_date("ts")).alias("__newest"))
    first, last = F.to_date("entry_ts"), F.least(F.to_date("until"), F.col("__newest"))
    return trades.join(newest, "symbol").where(first <= last).withColumn("__day", F.explode(F.sequence(first, last))).drop("__newest")


def _touches(trades: DataFrame, candles: DataFrame) -> DataFrame:
    """Per trade the first candle after its entry that touches stop or target: (signal_id, touch struct).

    Trades and candles meet on the symbol and the days a trade is watched (to
    its expiry, or to the symbol's newest candle), so a trade sees few candles
    however long the series is; tasks send one row per trade.
    """
    c = candles.select("symbol", F.col("ts").alias("c_ts"), "low", "high", F.to_date("ts").alias("__day"))
    hit = _watched(trades.select("signal_id", "symbol", "entry_ts", "stop_loss", "take_profit", "until"), candles).join(c, ["symbol", "__day"]).where((F.col("c_ts") > F.col("entry_ts")) & (F.col("until").isNull() | (F.col("c_ts") < F.col("until"))) & ((F.col("low") <= F.col("stop_loss")) | (F.col("high") >= F.col("take_profit"))))
    return hit.groupBy("signal_id").agg(F.min(F.struct("c_ts", (F.col("low") <= F.col("stop_loss")).alias("stopped"), (F.col("high") >= F.col("take_profit")).alias("won"))).alias("touch"))


def _resolved(df: DataFrame) -> DataFrame:
    """status, exit_reason, exit_price, profit_pct from touch and expired (with the price at expiry)."""
    both, stop = F.col("touch.stopped") & F.col("touch.won"), F.col("touch.stopped")
    has = F.col("touch").isNotNull()
    df = df.withColumn("status", F.when(F.col("expired"), "EXPIRED").when(has & stop, "LOSS").when(has, "WIN").otherwise("OPEN"))
    df = df.withColumn("exit_reason", F.when(F.col("expired"), "TIMEOUT_48H").when(has & both, "BOTH_HIT_CONSERVATIVE").when(has & stop, "STOP_LOSS_HIT").when(has, "TAKE_PROFIT_HIT"))
    df = df.withColumn("exit_price", F.when(F.col("status") == "EXPIRED", F.coalesce("expiry_price", "entry_price")).when(F.col("status") == "LOSS", F.col("stop_loss")).when(F.col("status") == "WIN", F.col("take_profit")))
    pct = profit_pct(F.col("status"), F.col("entry_price"), F.col("stop_loss"), F.col("take_profit"), F.col("exit_price"))
    return df.withColumn("profit_pct", F.when(F.col("status") != "OPEN", pct))


def resolve_snapshot(trades: DataFrame, candles: DataFrame, as_of: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Outcomes at one time: trades of expiry age or more are EXPIRED at the last close, whatever they touched; others by their first touch.

    *trades*: one row per signal_id with symbol, entry_ts, entry_price,
    stop_loss, take_profit; *as_of*: one row per symbol (symbol, as_of,
    last_close); symbols without one stay open.
    """
    t = trades.dropDuplicates(["signal_id"]).join(as_of, "symbol", "left").withColumn("until", F.lit(None).cast("timestamp_ntz"))
    t = t.withColumn("expired", F.coalesce(F.col("as_of") - F.col("entry_ts") >= F.make_dt_interval(hours=F.lit(config.trade_expiry_hours)), F.lit(False))).withColumn("expiry_price", F.col("last_close"))
    touches = _touches(t.where("not expired"), candles)
    return _resolved(t.join(touches, "signal_id", "left"))


def resolve_replay(trades: DataFrame, candles: DataFrame, as_of: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Outcomes as frequent polling would find them: first touch before entry plus expiry, else EXPIRED at the last close before it, open if that time has not come."""
    t = trades.dropDuplicates(["signal_id"]).join(as_of, "symbol", "left").withColumn("until", F.col("entry_ts") + F.make_dt_interval(hours=F.lit(config.trade_expiry_hours)))
    t = t.join(_touches(t, candles), "signal_id", "left")
    t = t.withColumn("expired", F.col("touch").isNull() & F.coalesce(F.col("as_of") >= F.col("until"), F.lit(False)))
    late = _watched(t.where("expired").select("signal_id", "symbol", "entry_ts", "until"), candles).join(candles.select("symbol", F.to_date("ts").alias("__day"), F.col("ts").alias("c_ts"), "close"), ["symbol", "__day"])
    price = late.where("c_ts > entry_ts and c_ts < until").groupBy("signal_id").agg(F.max_by("close", "c_ts").alias("expiry_price"))
    return _resolved(t.join(price, "signal_id", "left"))


def money(c: Column) -> Column:
    """Signed dollars with thousands separators."""
    return F.concat(F.when(c < 0, "-$").otherwise("+$"), F.format_number(F.abs(c), 2))


def metrics_text(metrics: DataFrame, by: str = "system") -> DataFrame:
    """(system, message): one line of figures for reports and dashboards."""
    factor = F.when(F.col("profit_factor") == float("inf"), "∞").otherwise(F.format_number("profit_factor", 2))
    return metrics.select(by, F.concat(F.lit("System "), F.col(by), F.lit(": "), F.col("trades").cast("string"), F.lit(" trades, win rate "), F.format_number("win_rate", 1), F.lit("%, P&L "), money(F.col("pnl")), F.lit(", profit factor "), factor).alias("message"))


def cooldown(ledger: DataFrame, config: Config = DEFAULT, by: str = "system") -> DataFrame:
    """Gates per trade, from configuration: minutes since the last loss, the day's loss so far, trades open before it, the hour, and reward to risk where the ledger has it.

    A task takes a day of a system; days meet as a row each.  Trades without a time come first.
    """
    day, order = F.to_date("timestamp"), ("timestamp", "signal_id")
    loss = F.when(F.col("result") == "LOSS", F.col("exit_time"))
    # what the days before leave behind, a row a day, and then the day's own trades
    left = ledger.groupBy(F.col(by).alias("__by"), day.alias("__day")).agg(F.count_if(F.col("status") == "OPEN").alias("__open"), F.max_by(loss, F.when(loss.isNotNull(), F.struct(*order))).alias("__lost"))
    days = Window.partitionBy("__by").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    left = left.select("__by", "__day", F.coalesce(F.sum("__open").over(days), F.lit(0)).alias("__open"), F.last("__lost", ignorenulls=True).over(days).alias("__lost"))
    before = Window.partitionBy(by, day).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = ledger.join(left, F.col(by).eqNullSafe(F.col("__by")) & day.eqNullSafe(F.col("__day")))
    df = df.withColumn("day_pnl", F.coalesce(F.sum("profit_pct").over(before), F.lit(0.0))).withColumn("open_before", F.col("__open") + F.count_if(F.col("status") == "OPEN").over(before))
    lost = F.coalesce(F.last(loss, ignorenulls=True).over(before), F.col("__lost"))
    df = df.withColumn("__lost", lost).drop("__by", "__day", "__open")
    df = df.withColumn("in_cooldown", F.coalesce(F.col("timestamp") < F.col("__lost") + F.make_dt_interval(mins=F.lit(config.cooldown_minutes)), F.lit(False))).drop("__lost")
    df = df.withColumn("hour_blocked", F.hour("timestamp").isin(*config.block_hours) if config.block_hours else F.lit(False))
    reward = F.coalesce(F.col("rr_ratio").try_cast("double") >= config.least_reward, F.lit(True)) if "rr_ratio" in ledger.columns else F.lit(True)
    return df.withColumn("allowed", ~F.col("in_cooldown") & ~F.col("hour_blocked") & (F.col("day_pnl") > config.day_loss_cap) & (F.col("open_before") < config.max_open) & reward)
