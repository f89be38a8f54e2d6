"""Gates with feedback against a plain loop, labels and folds."""

import datetime as dt
import random
from dataclasses import replace

from pyspark.sql import functions as F

from tickloom.config import DEFAULT
from tickloom.operators import admission, ml
from tickloom.plans import catalog

T0 = dt.datetime(2025, 1, 6, 8)


def plain(trades, config):
    """Each trade against the list of all trades taken before it."""
    out, taken = {}, {}
    for t in sorted(trades, key=lambda t: (t["timestamp"], t["signal_id"])):
        mine, at = taken.setdefault(t["account"], []), t["timestamp"]
        ended = [x for x in mine if x["exit_time"] is not None and x["exit_time"] <= at]
        monday = at.date() - dt.timedelta(days=at.weekday())
        day = sum(x["profit_pct"] or 0 for x in ended if x["exit_time"].date() == at.date())
        week = sum(x["profit_pct"] or 0 for x in ended if x["exit_time"].date() >= monday)
        losses = [x["exit_time"] for x in ended if x["result"] == "LOSS"]
        reason = (
            "hour" if at.hour in config.block_hours else "reward" if t["rr_ratio"] is not None and t["rr_ratio"] < config.least_reward else "open_trades" if len(mine) - len(ended) >= config.max_open
            else "cooldown" if losses and at < max(losses) + dt.timedelta(minutes=config.cooldown_minutes) else "day_loss" if round(day, 9) <= config.day_loss_cap else "week_loss" if round(week, 9) <= config.week_loss_cap else None
        )
        if reason is None:
            mine.append(t)
        out[t["signal_id"]] = reason
    return out


def test_gates_with_feedback(spark):
    rnd, rows = random.Random(2), []
    for k in range(900):
        at = T0 + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 30) // 10 * 10)
        end = None if rnd.random() < 0.02 else at + dt.timedelta(minutes=rnd.randint(0, 2000))
        pnl = None if rnd.random() < 0.05 else rnd.choice((-2.0, -1.0, -0.5, 0.5, 1.5))
        rows.append({"account": rnd.choice("ab"), "signal_id": k, "timestamp": at, "exit_time": end, "profit_pct": pnl, "result": None if pnl is None else "LOSS" if pnl < 0 else "WIN", "rr_ratio": None if rnd.random() < 0.1 else rnd.choice((1.0, 2.0, 3.0))})
    config = replace(DEFAULT, max_open=4, block_hours=(21, 22), day_loss_cap=-2.0, week_loss_cap=-5.0)
    df = spark.createDataFrame(rows, "account string, signal_id long, timestamp timestamp_ntz, exit_time timestamp_ntz, profit_pct double, result string, rr_ratio double")
    got = {r["signal_id"]: r["blocked_reason"] for r in admission.admitted(df, config).collect()}
    want = plain(rows, config)
    assert got == want and {None, *admission.REASONS} == set(want.values())
    odd = spark.createDataFrame([(None, 1, T0, None, None, None), ("a", None, T0, None, None, None), ("a", 3, None, None, None, None)], "account string, signal_id long, timestamp timestamp_ntz, exit_time timestamp_ntz, profit_pct double, result string")
    assert [(r["account"], r["signal_id"], r["admitted"]) for r in admission.admitted(odd).collect()] == [("", 1, True)]
    assert admission.admitted(df.limit(0)).count() == 0


def test_registered_gates(spark, sf_dir):
    got = catalog.risk_admission(spark, sf_dir)
    rows = {r["signal_id"]: r["blocked_reason"] for r in got.collect()}
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    from tickloom.operators import ledger

    all_ = ledger.from_orders(orders).join(orders.select(F.col("o_orderkey").alias("signal_id"), F.pmod("o_custkey", F.lit(97)).alias("account")), "signal_id")
    trades = [r.asDict() | {"rr_ratio": 1.5 + r["signal_id"] % 5 / 4.0} for r in all_.select("account", "signal_id", "timestamp", "exit_time", "profit_pct", "result").collect()]
    assert rows == plain(trades, replace(DEFAULT, max_open=3, block_hours=(21, 22)))


def test_folds_do_not_leak(spark, sf_dir):
    rows = spark.createDataFrame([(T0 + dt.timedelta(hours=k), T0 + dt.timedelta(hours=k + 48), k % 2) for k in range(200)], "ts timestamp_ntz, known_ts timestamp_ntz, label int")
    cuts = [T0 + dt.timedelta(hours=h) for h in (100, 150)]
    folds = ml.walk_forward(rows, cuts, gap_hours=2).collect()
    for k, cut in enumerate(cuts):
        train = [r for r in folds if r["fold"] == k and r["role"] == "train"]
        test = [r for r in folds if r["fold"] == k and r["role"] == "test"]
        assert max(r["known_ts"] for r in train) < cut - dt.timedelta(hours=2) and min(r["ts"] for r in test) == cut
        assert len(train) == {0: 50, 1: 100}[k] and len(test) == 50
    auc = catalog.walk_forward_auc(spark, sf_dir).collect()
    assert all(0 <= r["auc"] <= 1 and r["trained"] > 0 and r["tested"] > 0 for r in auc)
