import datetime as dt

from pyspark.sql import functions as F

from tickloom.operators import ledger
from tickloom.sources import market

T0 = dt.datetime(2025, 1, 6)
ROW = "system string, signal_id long, result string, status string, profit_pct string, exit_time timestamp_ntz, signal_quality string, trend_filter_result string"


def rows(spark, *rs):
    return spark.createDataFrame([("A", k, r, s, p, T0 + dt.timedelta(hours=h), "STRONG", "TREND_OK") for k, (r, s, p, h) in enumerate(rs)], ROW)


def test_csv_round_trip(spark, tmp_path):
    none = ledger.read_ledger(spark, str(tmp_path / "missing"))
    assert none.columns == list(ledger.LEDGER_A) and none.count() == 0
    sig = spark.createDataFrame([("XAUUSD", "2025-01-06T10:00:00Z", "BUY", "2400.5", None, 'quote " and, comma'), ("XAUUSD", "2025-01-06T11:00:00Z", "BUY", "2401", "spread", "b")], "symbol string, timestamp string, direction string, entry_price string, blocked_reason string, plain_english_summary string")
    full = ledger.log_signals(none, sig)
    ledger.write_ledger(full, str(tmp_path / "v1"))
    ledger.append_ledger(ledger.log_signals(none, sig).where("status = 'OPEN'"), str(tmp_path / "v1"))
    back = ledger.read_ledger(spark, str(tmp_path / "v1"))
    assert back.count() == 3 and sorted(r["status"] for r in back.collect()) == ["BLOCKED", "OPEN", "OPEN"]
    assert back.where("status = 'OPEN'").first()["plain_english_summary"] == 'quote " and, comma'
    (tmp_path / "old.csv").write_text("pnl,pair\n1.5,X\nbad,Y\n,Z\n")
    old = ledger.read_ledger(spark, str(tmp_path / "old.csv"), ledger.LEDGER_C)
    assert old.columns == list(ledger.LEDGER_C)
    m = ledger.dashboard_metrics(old.withColumn("system", F.lit("C"))).first()
    assert (m["trades"], m["wins"], m["losses"], m["pnl"], m["profit_factor"]) == (3, 1, 0, 1.5, 1.5)
    assert ledger.closed_trades(old).count() == 3


def test_factors(spark):
    no_loss = rows(spark, ("WIN", "CLOSED", "2", 1))
    assert ledger.profit_factor(no_loss).first()[0] == float("inf") and ledger.dashboard_metrics(no_loss).first()["profit_factor"] == 2.0
    some = rows(spark, ("WIN", "CLOSED", "3", 1), ("LOSS", "CLOSED", "-2", 2), ("EXPIRED", "CLOSED", "5", 3), ("WIN", "CLOSED", "text", 4))
    assert ledger.profit_factor(some).first()[0] == 1.5 and ledger.dashboard_metrics(some).first()["profit_factor"] == 4.0
    assert "∞" in ledger.metrics_text(ledger.dashboard_metrics(no_loss).withColumn("profit_factor", F.lit(float("inf")))).first()["message"]


def test_streaks(spark):
    def of(*rs):
        got = ledger.streaks(rows(spark, *rs)).collect()
        return tuple(got[0])[1:] if got else None

    assert of(("LOSS", "C", "-1", 1), ("WIN", "C", "1", 2), ("WIN", "C", "1", 3)) == (2, 0)
    assert of(("WIN", "C", "1", 1), ("LOSS", "C", "-1", 2)) == (0, 1)
    assert of(("WIN", "C", "1", 1), ("EXPIRED", "C", "0", 2)) == (0, 0)
    assert of(("LOSS", "C", "-1", 5), ("LOSS", "C", "-1", 5), ("WIN", "C", "1", 1)) == (0, 2)
    assert of((None, "OPEN", None, 1)) is None


def test_best_worst_and_curve(spark):
    df = rows(spark, ("WIN", "C", "2", 1), ("WIN", "C", "2", 2), ("LOSS", "C", "-3", 3), ("LOSS", "C", "nan?", 4))
    assert tuple(ledger.best_worst(df).first()) == ("A", 0, 2.0, 2, -3.0)
    curve = ledger.equity_curve(df, last=2).orderBy("signal_id").collect()
    assert [(r["signal_id"], r["equity"]) for r in curve] == [(2, 10001.0), (3, 10001.0)]
    assert ledger.running_stats(df.where("false")).count() == 0


def trades(spark, *ts):
    return spark.createDataFrame([(f"t{k}", "S", T0 + dt.timedelta(hours=h), e, s, t) for k, (h, e, s, t) in enumerate(ts)], "signal_id string, symbol string, entry_ts timestamp_ntz, entry_price double, stop_loss double, take_profit double")


def test_barriers(spark):
    bars = [(1, 101.0, 99.0), (2, 106.0, 94.0), (3, 101.0, 99.0), (60, 111.0, 99.0)]
    candles = spark.createDataFrame([("S", T0 + dt.timedelta(hours=h), 100.0, hi, lo, 100.5) for h, hi, lo in bars], "symbol string, ts timestamp_ntz, open double, high double, low double, close double")
    df = trades(spark, (0, 100.0, 95.0, 105.0), (0, 100.0, 94.5, 107.0), (0, 100.0, 90.0, 105.5), (2, 100.0, 95.0, 105.0), (20, 100.0, 95.0, 105.0))
    as_of = spark.createDataFrame([("S", T0 + dt.timedelta(hours=48), 100.5)], "symbol string, as_of timestamp_ntz, last_close double")
    snap = {r["signal_id"]: (r["status"], r["exit_reason"]) for r in ledger.resolve_snapshot(df, candles, as_of).collect()}
    assert snap["t0"] == snap["t1"] == snap["t2"] == ("EXPIRED", "TIMEOUT_48H")  # exactly 48 hours old
    assert snap["t3"] == ("WIN", "TAKE_PROFIT_HIT") and snap["t4"][0] == "WIN"
    later = spark.createDataFrame([("S", T0 + dt.timedelta(hours=70), 100.5)], "symbol string, as_of timestamp_ntz, last_close double")
    rep = {r["signal_id"]: (r["status"], r["exit_reason"], r["exit_price"]) for r in ledger.resolve_replay(df, candles, later).collect()}
    assert rep["t0"] == ("LOSS", "BOTH_HIT_CONSERVATIVE", 95.0) and rep["t1"] == ("LOSS", "STOP_LOSS_HIT", 94.5) and rep["t2"] == ("WIN", "TAKE_PROFIT_HIT", 105.5)
    assert rep["t3"] == ("EXPIRED", "TIMEOUT_48H", 100.5) and rep["t4"][0] == "WIN"
    assert ledger.resolve_snapshot(df.where("false"), candles, as_of).count() == 0
    twice = ledger.resolve_replay(df.unionByName(df), candles, later)
    assert twice.count() == 5


def test_target_text(spark):
    texts = ["np.float64(4220.84)", "[np.float64(4220.84)]", "[4220.84]", "[none]", "4220.84", None]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(ledger.clean_target(F.col("x"))).collect()] == ["4220.84", "4220.84", "4220.84", "N/A", "4220.84", None]


def test_sources(spark):
    raw = spark.createDataFrame([("S", "1H", "2025-01-06T10:00:00Z", "1", "2", "0.5", "1.5", None), ("S", "1H", "bad", "1", "2", "0.5", "1.5", "3"), ("S", "1H", "2025-01-06T11:00:00", "x", "2", "0.5", "1.5", "3")], "symbol string, tf string, time string, open string, high string, low string, close string, tickVolume string")
    got = market.normalise_raw(raw).collect()
    assert len(got) == 1 and got[0]["volume"] == 0.0 and got[0]["ts"] == dt.datetime(2025, 1, 6, 10)
    few = spark.createDataFrame([("S", "1H", T0 + dt.timedelta(hours=i), 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(51)] + [("M", "15M", T0 + dt.timedelta(hours=i), 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(20)], "symbol string, tf string, ts timestamp_ntz, open double, high double, low double, close double, volume double")
    kept = market.drop_incomplete(few)
    assert kept.count() == 19 and {r["symbol"] for r in kept.collect()} == {"M"}
    acc = spark.createDataFrame([("a", "GOLD", 3), ("a", "XAUUSD", 5), ("b", "XAUUSDm", 0), ("b", "XAU/USD", 1), ("c", "OTHER", 9)], "account string, symbol string, bars int")
    assert {tuple(r) for r in market.resolve_symbol(acc).collect()} == {("a", "XAUUSD"), ("b", "XAU/USD")}
