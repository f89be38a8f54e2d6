"""Gates that know what was admitted: trades in order of time, each decided by those admitted before it."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.config import DEFAULT, Config

HOUR, DAY = 3_600_000, 86_400_000
#: Reasons, in the order they are looked at.
REASONS = ("hour", "reward", "open_trades", "cooldown", "day_loss", "week_loss")


class Gates:
    """One account's gates; times in milliseconds.  Only admitted trades change them."""

    def __init__(self, config: Config):
        self.config = config
        self.open: list[tuple[float, float, bool]] = []  # ends, results and whether it is a loss of admitted trades that go on
        self.last_loss = float("-inf")
        self.day = self.week = -1
        self.day_pnl = self.week_pnl = 0.0

    def _to(self, now: int) -> None:
        """Close what has ended by *now*; its result counts on the day and in the week of its end."""
        while self.open and self.open[0][0] <= now:
            end, pnl, loss = heapq.heappop(self.open)
            self._turn(end)
            self.day_pnl += pnl
            self.week_pnl += pnl
            if loss:
                self.last_loss = end
        self._turn(now)

    def _turn(self, at: float) -> None:
        # weeks from Monday; the epoch was a Thursday
        day, week = at // DAY, (at + 3 * DAY) // (7 * DAY)
        if day != self.day:
            self.day, self.day_pnl = day, 0.0
        if week != self.week:
            self.week, self.week_pnl = week, 0.0

    def decide(self, at: int, end: float, pnl: float, loss: bool, reward: float) -> str:
        """The reason a trade is blocked for, or '' and it is taken."""
        c = self.config
        self._to(at)
        holds = (
            at % DAY // HOUR in c.block_hours, reward < c.least_reward, len(self.open) >= c.max_open, at < self.last_loss + c.cooldown_minutes * 60_000,
            round(self.day_pnl, 9) <= c.day_loss_cap, round(self.week_pnl, 9) <= c.week_loss_cap,
        )
        for name, blocked in zip(REASONS, holds, strict=True):
            if blocked:
                return name
        heapq.heappush(self.open, (end, pnl, loss))
        return ""


def fold(config: Config):
    """Rows sorted by account and time to their decisions; of an account only its gates are held."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, gates = None, Gates(config)
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if r.account != account:
                    account, gates = r.account, Gates(config)
                end = float("inf") if pd.isna(r.end) else float(r.end)
                reward = float("inf") if pd.isna(r.reward) else r.reward
                out.append(gates.decide(int(r.at), end, 0.0 if pd.isna(r.pnl) else r.pnl, r.loss, reward))
            yield pd.DataFrame({"account": rows["account"], "id": rows["id"], "reason": out})

    return run


def admitted(trades: DataFrame, config: Config = DEFAULT, *, by: str = "account", id_col: str = "signal_id") -> DataFrame:
    """(account, id, admitted, blocked_reason) of trades that are offered: (*by*, *id_col*, timestamp, exit_time, profit_pct, result, and rr_ratio if there is one).

    The open trades, the time since the last loss, and the day's and week's
    results count admitted trades only, and those only once they have ended: a
    trade that is blocked blocks nothing.  An account is decided in order of
    time, ties by id, in one task, which holds its open trades and nothing else.

    * null accounts are one; rows without an id or a time are left out;
    * a trade without an end stays open; an unknown result is 0, an unknown
      ratio passes.
    """
    reward = F.col("rr_ratio").try_cast("double") if "rr_ratio" in trades.columns else F.lit(None).cast("double")
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    kind = trades.schema[id_col].dataType.simpleString()
    rows = trades.where(F.col(id_col).isNotNull() & F.col("timestamp").isNotNull()).select(
        F.coalesce(F.col(by).cast("string"), F.lit("")).alias("account"), F.col(id_col).alias("id"), ms("timestamp").alias("at"), ms("exit_time").cast("double").alias("end"),
        F.col("profit_pct").try_cast("double").alias("pnl"), F.coalesce(F.col("result") == "LOSS", F.lit(False)).alias("loss"), reward.alias("reward"),
    )
    sent = rows.repartition("account").sortWithinPartitions("account", "at", "id")
    told = sent.mapInPandas(fold(config), f"account string, id {kind}, reason string")
    return told.select(F.col("account").alias(by), F.col("id").alias(id_col), (F.col("reason") == "").alias("admitted"), F.nullif("reason", F.lit("")).alias("blocked_reason"))
