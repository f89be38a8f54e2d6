import datetime as dt

from pyspark.sql import functions as F

from tickloom.operators import decisions, sessions

MONDAY = dt.datetime(2025, 6, 2)


def at(spark, times, **cols):
    return [r.asDict() for r in spark.createDataFrame([(t,) for t in times], "ts timestamp_ntz").select("ts", *[c.alias(k) for k, c in cols.items()]).collect()]


def test_every_half_hour_of_a_week(spark):
    times = [MONDAY + dt.timedelta(minutes=30 * k) for k in range(336)]
    for r in at(spark, times, tier=sessions.tier(F.col("ts")), session=sessions.session(F.col("ts")), zone=sessions.killzone(F.col("ts")), open=sessions.market_open(F.col("ts"))):
        t = r["ts"]
        clock, day = t.hour + t.minute / 60, t.weekday()
        shut = day > 4 or (day == 4 and clock >= 21)
        assert r["tier"] == ("closed" if shut else "peak" if 13 <= clock < 16.5 else "high" if 8 <= clock < 20 else "secondary")
        assert r["session"] == ("asia" if t.hour in (20, 21, 22, 23, 0, 1, 2, 3, 4, 5, 6, 7) else "london" if t.hour < 17 else "ny")
        assert r["zone"] == ("London Open" if 6 <= clock < 10 else "NY AM" if 11 <= clock < 16 else None) and r["open"] == (day < 5)


def test_news_guard(spark):
    cases = {
        "2025-06-07 12:00:00": "weekend", "2025-06-06 20:59:59": None, "2025-06-06 21:00:00": "friday_close", "2025-06-08 21:59:00": "sunday_before_open", "2025-06-08 22:00:00": None,
        "2025-06-06 13:24:59": None, "2025-06-06 13:25:00": "jobs_report", "2025-06-06 14:05:00": "jobs_report", "2025-06-06 14:05:01": None, "2025-06-13 13:30:00": None,
        "2025-06-18 16:59:00": None, "2025-06-18 17:00:00": "rate_statement", "2025-06-18 21:59:00": "rate_statement", "2025-06-18 22:00:00": None, "2025-06-11 13:00:00": "price_release", "2025-06-11 15:00:00": None,
    }
    got = at(spark, [dt.datetime.fromisoformat(c) for c in cases], why=sessions.news_guard(F.col("ts")))
    assert [r["why"] for r in got] == list(cases.values())


def test_lookups_have_defaults(spark):
    row = spark.range(1).select(sessions.size_multiplier(F.lit("odd")).alias("a"), sessions.confidence_gate(F.lit(None).cast("string")).alias("b"), sessions.stop_width(F.lit(2.0), F.lit("closed")).alias("c"), sessions.can_trade(F.lit("NONE"), F.lit("WEAK")).alias("d"), sessions.can_trade(F.lit("STRONG"), F.lit("odd")).alias("e"), sessions.description(F.lit("closed")).alias("f")).first()
    assert tuple(row) == (0.0, "STRONG", 3.0, False, True, "no market open")


def test_times(spark):
    row = spark.createDataFrame([("2025-01-01T10:00:00Z", "2025-01-01T10:00:00+02:00", "no time", 1735725600000)], "a string, b string, c string, d long").select(sessions.parse_iso(F.col("a")).alias("a"), sessions.parse_iso(F.col("b")).alias("b"), sessions.parse_iso(F.col("c")).alias("c"), sessions.from_millis(F.col("d")).alias("d")).first()
    assert row["a"] == row["d"] == dt.datetime(2025, 1, 1, 10) and row["b"] == dt.datetime(2025, 1, 1, 8) and row["c"] is None
    assert at(spark, [dt.datetime(2025, 7, 1, 10)], x=sessions.local_text(F.col("ts")))[0]["x"] == "2025-07-01 12:00"


def test_composite_by_hand(spark):
    df = spark.createDataFrame([(80.0, 45.0, 50.0, "peak"), (80.0, None, None, "odd"), (100.0, 100.0, 99.0, "closed")], "smc_score double, ml_confidence double, analyst_confidence double, tier string")
    rows = decisions.composite_decision(df).collect()
    assert abs(rows[0]["combined"] - 57.25) < 1e-9 and rows[0]["should_trade"] and rows[0]["threshold"] == 50 and rows[0]["reason"] == "accepted: model 45, analyst 50 and structure 80 make 57 of 50 needed"
    assert rows[1]["threshold"] == 52 and rows[1]["combined"] == 59.0 and not rows[2]["should_trade"]
    got = decisions.filter_decision(df).collect()
    assert [r["threshold"] for r in got] == [60, 70, 100] and abs(got[0]["combined"] - 59.0) < 1e-9


def test_macro_by_hand(spark):
    df = spark.createDataFrame([("BUY", 0.3, -0.2, 15.0), ("SELL", 0.3, -0.2, 15.0), ("BUY", 0.9, 0.3, 25.0), ("SELL", 0.0, -0.5, 5.0)], "direction string, usd_momentum double, rate_momentum double, vix double")
    rows = decisions.macro_validate(decisions.macro_buckets(df)).collect()
    assert [(r["smt_score"], r["is_confirmed"], r["is_blocked"]) for r in rows] == [(80, True, False), (50, False, False), (65, False, True), (65, False, True)]
    assert rows[0]["risk_sentiment"] == 75 and rows[0]["reasoning"] == "cross-market score 80, dollar weak for, rates falling for, equities neutral against" and rows[2]["reasoning"].startswith("blocked: ")


def test_analyst_replies(spark):
    texts = ["no object", '{"confidence": 39}', 'x {"confidence": 40, "should_trade": false, "reasoning": "a {b} c"} y', "{broken", None, "{}"]
    rows = decisions.parse_analyst(spark.createDataFrame([(t,) for t in texts], "response string")).collect()
    assert [(r["should_trade"], r["analyst_confidence"]) for r in rows] == [(True, 50.0), (True, 40.0), (False, 40.0), (True, 50.0), (True, 50.0), (True, 50.0)]
    assert rows[2]["reasoning"] == "a {b} c" and [r["parsed"] for r in rows] == [False, True, True, False, False, True]


def test_score_and_levels(spark):
    cols = "struct_4h string, struct_1d string, struct_1w string, broke_4h boolean, at_block boolean, gap_1h boolean, sweep_1h boolean, broke_15m boolean, adx_15m double, rsi_15m double, in_killzone boolean"
    rows = [("bullish", "bullish", "bullish", True, True, True, True, True, 30.0, 60.0, True), ("ranging", "ranging", "ranging", True, True, True, True, True, 30.0, 60.0, True), ("bearish", None, None, False, False, True, None, None, None, 50.0, False)]
    df = spark.createDataFrame(rows, cols)
    s = {c.split()[0]: F.col(c.split()[0]) for c in cols.split(", ")}
    assert [r[0] for r in df.select(decisions.confluence_score(s)).collect()] == [100, 0, 20]
    lv = spark.createDataFrame([(100.0, 2.0, 106.0, 98.0, False, None, None, "BUY"), (100.0, 2.0, None, 98.0, True, 97.0, False, "SELL"), (100.0, 2.0, None, None, None, None, None, "SELL")], "price double, atr double, tp_level double, ob15_low double, ob15_mitigated boolean, ob4_low double, ob4_mitigated boolean, direction string")
    got = decisions.signal_levels(lv).collect()
    assert [r["sl_source"] for r in got] == ["15M_OB", "4H_OB", "ATR"] and got[2]["stop_loss"] == 97.0 and got[2]["take_profit"] == 106.0 and got[2]["rr_ratio"] == 2.0
    aware = decisions.signal_levels(lv, side_aware=True).collect()
    assert aware[2]["stop_loss"] == 103.0 and aware[2]["take_profit"] == 94.0 and aware[2]["rr_ratio"] == 2.0
    assert decisions.split_targets(got and decisions.signal_levels(lv)).count() == 9


def test_prompt(spark):
    sig = spark.createDataFrame([("X", "BUY", 70, 2400.0), ("Y", "SELL", 50, 1.0)], "symbol string, direction string, smc_score int, price double")
    pos = spark.createDataFrame([("X", "BUY", f"{k}", 1.0, 2.0) for k in range(5)], "symbol string, direction string, signal_id string, entry_price double, pnl double")
    got = {r["symbol"]: r["prompt"] for r in decisions.analyst_prompt(sig, pos).collect()}
    assert got["X"].count("BUY X from 1.0, result 2.0\n") == 3 and "Open positions:\nnone\n" in got["Y"] and "Levels: stop unknown, target unknown" in got["Y"]
