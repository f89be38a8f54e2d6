import datetime as dt
import json

from pyspark.sql import functions as F

from tickloom import config
from tickloom.operators import decisions, ledger, reports


def test_config_file(tmp_path):
    assert config.load(str(tmp_path / "none.json")) == config.DEFAULT
    (tmp_path / "c.json").write_text(json.dumps({"composite_decision": {"ml_weight": 0.5, "other_weight": 0.2, "smc_weight": 0.3, "fire_thresholds": {"peak": 40}}, "smc_parameters": {"fair_value_gap": {"max_lookback": 30}}}))
    got = config.load(str(tmp_path / "c.json"))
    assert got.weights_composite == (0.5, 0.2, 0.3) and got.thresholds_composite == {"peak": 40} and got.gap_age == 30 and got.min_score == 45


def test_messages(spark):
    ts = dt.datetime(2025, 1, 6, 12)
    df = spark.createDataFrame([("S1", "XAU", 77, "STRONG", 1.0, 1.1, 2.0, 0.9, 5.0, 2.5, 3.0, "spread", ts, "T", "m" * 900, "retry")], "signal_id string, symbol string, score int, signal_quality string, entry_low double, entry_high double, take_profit double, stop_loss double, tp_pct double, sl_pct double, rr_ratio double, blocked_reason string, ts timestamp_ntz, error_type string, error_message string, recovery_action string")
    assert "Score 77/100" in reports.signal_message(df).first()["message"]
    assert reports.block_message(df).first()["message"].endswith("Time: 2025-01-06 13:00")
    assert "m" * 500 in (m := reports.alert_message(df).first()["message"]) and "m" * 501 not in m


def test_quiet_scans(spark):
    rows = [(dt.datetime(2025, 1, 5, 23, 30), 1, 0, 0, 0, 0), (dt.datetime(2025, 1, 6, 0, 30), 1, 0, 0, 0, 0), (dt.datetime(2025, 1, 6, 12), 1, 1, 0, 1, 0)]
    got = [r["message"] for r in reports.scan_summary(spark.createDataFrame(rows, "ts timestamp_ntz, scanned int, shortlisted int, signals_logged int, signals_blocked int, open_trades int")).collect()]
    assert got[0] and got[1] is None and "blocked by risk" in got[2]


def test_dashboard_rows_by_fallback(spark):
    df = spark.createDataFrame([("2025-01-06T1", None, "[np.float64(4220.5)]", "1.5"), ("2025-01-07T1", "<b>", "x", "bad")], "timestamp string, entry string, take_profits string, pnl string")
    rows = reports.dashboard_rows(df).collect()
    assert [(r["pair"], r["entry"], r["target"], r["outcome"], r["pnl"], r["date"]) for r in rows] == [("XAUUSD", "<b>", "x", "OPEN", "+$0.00", "2025-01-07"), ("XAUUSD", "N/A", "4220.5", "WIN", "+$1.50", "2025-01-06")]
    assert "&lt;b&gt;" in reports.html_rows(reports.dashboard_rows(df)).first()["html"]


def test_sizes(spark):
    df = spark.createDataFrame([(39.0, 2.0, 1.0), (50.0, 2.0, 0.9), (61.0, 2.0, 0.0), (99.0, 0.0, 1.0)], "win_rate double, rr_ratio double, size_multiplier double")
    rows = reports.position_size(df).collect()
    assert [r["size"] for r in rows] == [2500.0, 4500.0, 0.0, 7500.0] and rows[1]["kelly"] == 0.25 and rows[3]["kelly"] == 0.0
    led = spark.createDataFrame([("A", dt.datetime(2025, 1, 6 + d), v) for d, v in ((0, -2.0), (1, -2.9), (2, -1.5), (7, -1.0))], "system string, timestamp timestamp_ntz, profit_pct double")
    assert [r["stopped"] for r in reports.loss_caps(led).orderBy("day").collect()] == [False, False, True, False]
    assert led.where(F.lit(False)).count() == 0


def test_gates_and_sizes_from_a_file(spark, tmp_path):
    gates = {"daily_loss_cap_pct": -2.0, "weekly_loss_cap_pct": -5.0, "max_open_trades": 2, "min_risk_reward_ratio": 1.5, "sl_cooldown_minutes": 30, "block_hours": {"night": [21, 22]}}
    sizes = {"base_size_usd": 100, "kelly_fraction_cap": 0.1, "split_tp_ratios": [0.5, 1.0], "win_rate_adjustments": {"below_40pct": 0.2, "40_to_60pct": 1.0, "above_60pct": 3.0}}
    (tmp_path / "g.json").write_text(json.dumps({"risk_gates": gates, "position_sizing": sizes}))
    c = config.load(str(tmp_path / "g.json"))
    assert (c.day_loss_cap, c.week_loss_cap, c.max_open, c.least_reward, c.cooldown_minutes, c.block_hours) == (-2.0, -5.0, 2, 1.5, 30, (21, 22))
    day = dt.datetime(2025, 1, 6)
    rows = [("1", day.replace(hour=9), "LOSS", day.replace(hour=10), -1.0, "CLOSED", "2.0"), ("2", day.replace(hour=10, minute=20), None, None, None, "OPEN", "1.0"), ("3", day.replace(hour=11), "LOSS", day.replace(hour=12), -1.5, "CLOSED", "2.0"), ("4", day.replace(hour=13), None, None, None, "OPEN", "2.0"), ("5", day.replace(day=7, hour=21), None, None, None, "OPEN", "2.0"), ("6", day.replace(day=8, hour=9), None, None, None, "OPEN", "2.0")]
    led = spark.createDataFrame([("A", *r) for r in rows], "system string, signal_id string, timestamp timestamp_ntz, result string, exit_time timestamp_ntz, profit_pct double, status string, rr_ratio string")
    got = {r["signal_id"]: r for r in ledger.cooldown(led, c).collect()}
    # a ratio under the least, the day's losses, the hour, two open trades
    assert [got[k]["allowed"] for k in "123456"] == [True, False, True, False, False, False] and got["2"]["in_cooldown"] and got["5"]["hour_blocked"] and not got["6"]["hour_blocked"]
    size = spark.createDataFrame([(39.0, 2.0, 1.0), (61.0, 2.0, 1.0)], "win_rate double, rr_ratio double, size_multiplier double")
    assert [(r["size"], round(r["kelly"], 9)) for r in reports.position_size(size, c).collect()] == [(20.0, 0.085), (300.0, 0.1)]
    assert decisions.split_targets(size.selectExpr("1.0 as price", "2.0 as take_profit"), c.target_shares).count() == 4


def test_ledgers_without_a_status_or_with_ids_as_text(spark):
    led = spark.createDataFrame([("C", "b", 2.0, "WIN", "2025-01-01"), ("C", "a", 2.0, "WIN", "2025-01-01"), ("C", "c", None, None, "2025-01-01"), ("A", "d", -1.0, "LOSS", "2025-01-02")], "system string, signal_id string, pnl double, result string, timestamp string")
    got = {r["system"]: (r["trades"], r["wins"], r["losses"]) for r in ledger.daily_metrics(led).collect()}
    assert got == {"C": (3, 2, 0), "A": (1, 0, 1)}
    best = {r["system"]: r for r in ledger.best_worst(led.withColumnRenamed("pnl", "profit_pct")).collect()}
    assert best["C"]["best_id"] == "a" and best["C"]["worst_id"] is None and best["A"]["worst_pct"] == -1.0
    known = spark.createDataFrame([(None, 5.0), (0.0, 5.0), (3.0, 5.0)], "ema double, price double").select(decisions.known_or(F.col("ema"), F.col("price")).alias("v")).collect()
    assert [r["v"] for r in known] == [5.0, 5.0, 3.0]


def test_strategy_file_without_a_band_and_ties_of_the_last_price(spark, tmp_path):
    import json

    from tickloom import config
    from tickloom.sources import market

    place = tmp_path / "p.json"
    place.write_text(json.dumps({"position_sizing": {"win_rate_adjustments": {"below_40pct": 0.25}}}))
    assert config.load(str(place)).size_factors == (0.25, *config.DEFAULT.size_factors[1:])
    rows = spark.sql("select * from values ('A', '1D', timestamp_ntz '2025-01-01', 3.0), ('A', '15M', timestamp_ntz '2025-01-01', 1.0), ('A', 'odd', timestamp_ntz '2025-01-01', 9.0), ('A', '1W', timestamp_ntz '2024-12-30', 5.0) as t(symbol, tf, ts, close)")
    assert [r["price"] for r in market.last_price(rows).collect()] == [1.0]


def test_trades_without_an_analyst(spark):
    from tickloom.operators import decisions

    rows = spark.sql("select * from values ('A', 'bullish', 2400.5, 2390.0, cast(null as double), 60, true, 'high'), ('B', 'bearish', 1.0, 1.1, 0.9, 70, true, 'closed'), ('C', 'bullish', 1.0, 0.9, 1.1, 20, false, 'high'), ('D', 'ranging', 1.0, 0.9, 1.1, 50, null, 'high') as t(symbol, struct_4h, price, stop_loss, take_profit, score, fired, tier)")
    got = decisions.direct_decision(rows).collect()
    assert [(r["symbol"], r["direction"], r["score"]) for r in got] == [("A", "BUY", 60)] and "target N/A" in got[0]["message"]


def test_gates_over_days_against_a_loop(spark):
    import datetime as dt
    import random

    rnd, start = random.Random(4), dt.datetime(2024, 1, 1)
    rows = []
    for k in range(200):
        at = None if k % 50 == 0 else start + dt.timedelta(minutes=rnd.randrange(6 * 1440))
        end = at + dt.timedelta(minutes=rnd.randrange(1500)) if at and rnd.random() < 0.8 else None
        rows.append((f"{k:03d}", rnd.choice(["A", "B", None]), at, end, rnd.choice(["LOSS", "WIN", None]), rnd.choice(["OPEN", "CLOSED"]), rnd.choice([-1.0, 0.5])))
    led = spark.createDataFrame(rows, "signal_id string, system string, timestamp timestamp, exit_time timestamp, result string, status string, profit_pct double")
    got = {r["signal_id"]: (r["day_pnl"], r["open_before"], r["in_cooldown"]) for r in ledger.cooldown(led).collect()}
    want, wait = {}, dt.timedelta(minutes=ledger.DEFAULT.cooldown_minutes)
    for system in ("A", "B", None):
        lost, opened, pnl = None, 0, {}
        for sid, _, at, end, result, status, profit in sorted((r for r in rows if r[1] == system), key=lambda r: (r[2] or dt.datetime.min, r[0])):
            day = at and at.date()
            want[sid] = (pnl.get(day, 0.0), opened, bool(at and lost and at < lost + wait))
            pnl[day] = pnl.get(day, 0.0) + profit
            opened += status == "OPEN"
            lost = end if result == "LOSS" and end else lost
    assert got == want and any(c for _, _, c in want.values())
