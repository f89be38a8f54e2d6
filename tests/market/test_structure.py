"""Structure operators against plain loops over random candles with many ties."""

import datetime as dt
import random

import pytest

from tickloom.functions.rolling import indexed
from tickloom.operators import structure

T0 = dt.datetime(2025, 1, 6)
SCHEMA = "symbol string, tf string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


def series(seed, n, step):
    rng, p, out = random.Random(seed), 100.0, []
    for _ in range(n):
        o = p
        c = o + rng.randint(-3, 3) * step
        out.append((o, max(o, c) + rng.randint(0, 2) * step, min(o, c) - rng.randint(0, 2) * step, c))
        p = c + rng.choice([0, 0, step])
    return out


ALL = {(f"S{k}", "1H"): series(k, n, s) for k, (n, s) in enumerate([(0, 1.0), (1, 1.0), (6, 1.0), (7, 1.0), (60, 1.0), (120, 1.0), (200, 0.5), (200, 2.0), (90, 0.0)])}
ALL |= {("D", "1D"): series(77, 150, 1.0), ("M", "15M"): series(78, 150, 1.0), ("W", "odd"): series(79, 80, 1.0)}
N = {"1H": 3, "1D": 5, "15M": 2, "odd": 3}


@pytest.fixture(scope="module")
def swung(spark):
    rows = [(s, t, T0 + dt.timedelta(hours=i), *b, 1.0) for (s, t), bars in ALL.items() for i, b in enumerate(bars)]
    return structure.swings(indexed(spark.createDataFrame(rows, SCHEMA))).cache()


class Facts:
    def __init__(self, tf, bars):
        self.o, self.h, self.l, self.c = (list(x) for x in zip(*bars, strict=True)) if bars else ([], [], [], [])
        k, n = N[tf], len(bars)
        near = lambda i: [j for j in range(i - k, i + k + 1) if j != i]
        inner = range(k, n - k)
        self.n = n
        self.tops = [i for i in inner if self.h[i] > max(self.h[j] for j in near(i))]
        self.lows = [i for i in inner if self.l[i] < min(self.l[j] for j in near(i))]

    def structure(self):
        if min(len(self.tops), len(self.lows)) < 2:
            return "ranging"
        a, b = self.h[self.tops[-1]] - self.h[self.tops[-2]], self.l[self.lows[-1]] - self.l[self.lows[-2]]
        return "bullish" if a > 0 and b > 0 else "bearish" if a < 0 and b < 0 else "ranging"

    def over(self, start, level):
        return next((j for j in range(start + 1, self.n) if self.c[j] > level), None)

    def bos(self):
        hits = [(self.over(s, self.h[s]), -s) for s in self.tops]
        hits = [x for x in hits if x[0] is not None]
        return (max(hits)[0], -max(hits)[1]) if len(self.tops) > 1 and hits else None

    def choch(self):
        prior = [s for s in self.tops if self.lows and s < self.lows[-1]]
        return self.over(self.lows[-1], self.h[prior[-1]]) if prior else None

    def sweep(self):
        found = [(-s, j) for s in self.lows[:-1] for j in range(max(s + 1, self.n - 20), self.n) if self.l[j] < self.l[s] < self.c[j]]
        return (-min(found)[0], min(found)[1]) if found else None

    def block(self):
        if not self.bos():
            return None
        j = self.bos()[0]
        down = [i for i in range(max(0, j - 20), j) if self.c[i] < self.o[i]]
        return (down[-1], min(self.c[j:]) < self.l[down[-1]]) if down else None

    def gap(self):
        good = []
        for i in range(max(2, self.n - 50) + 1, self.n):
            body, span, floor = self.c[i - 1] - self.o[i - 1], self.h[i - 1] - self.l[i - 1], self.h[i - 2]
            if body > 0 and span and body / span >= 0.6 and self.l[i] > floor and (self.l[i] - floor) / floor >= 0.001 and min(self.l[i:]) >= floor:
                good.append(i)
        return good[-1] if good else None


FACTS = {k: Facts(k[1], b) for k, b in ALL.items()}


def by_series(df, *cols):
    return {(r["symbol"], r["tf"]): tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def known(f):
    return {k: f(v) for k, v in FACTS.items() if f(v) is not None}


def test_swings(swung):
    got = [(r["symbol"], r["tf"], r["i"], r["swing_high"], r["swing_low"]) for r in swung.where("swing_high or swing_low").collect()]
    want = [(s, t, i, i in f.tops, i in f.lows) for (s, t), f in FACTS.items() for i in range(f.n) if i in f.tops or i in f.lows]
    assert sorted(got) == sorted(want)


def test_structure(swung):
    assert by_series(structure.market_structure(swung), "structure") == {k: f.structure() for k, f in FACTS.items() if f.n}


def test_breaks(swung):
    assert by_series(structure.bos_up(swung), "bos_index", "swing_high_index") == known(Facts.bos)
    assert by_series(structure.choch_up(swung), "choch_index") == known(Facts.choch)


def test_sweep_and_block(swung):
    got = {k: v for k, v in by_series(structure.liquidity_sweep(swung), "sweep_index", "swept_level").items()}
    assert got == {k: (v[1], FACTS[k].l[v[0]]) for k, v in known(Facts.sweep).items()}
    assert by_series(structure.order_block(swung), "ob_index", "mitigated") == known(Facts.block)


def test_gap(swung):
    assert by_series(structure.fvg_up(swung), "fvg_index") == {k: v - 1 for k, v in known(Facts.gap).items()}


def test_zone(swung):
    got = by_series(structure.premium_discount(swung), "zone", "pct_in_range")
    for k, f in FACTS.items():
        if not f.n:
            assert k not in got
            continue
        span = f.h[f.tops[-1]] - f.l[f.lows[-1]] if f.tops and f.lows else 0
        pct = (f.c[-1] - f.l[f.lows[-1]]) / span if span > 0 else 0.5
        zone = "unknown" if span <= 0 else "discount" if pct <= 0.4 else "premium" if pct >= 0.6 else "equilibrium"
        assert got[k] == (zone, pct)


def test_history_ends_like_the_present(swung):
    last = structure.structure_history(swung).where("i = n - 1")
    assert by_series(last, "structure") == {k: f.structure() for k, f in FACTS.items() if f.n}


def test_other_series_change_nothing(spark, swung):
    alone = structure.bos_up(swung.where("symbol = 'S6'"))
    assert [tuple(r) for r in alone.collect()] == [tuple(r) for r in structure.bos_up(swung).where("symbol = 'S6'").collect()]


def test_first_close_above_in_long_series(spark):
    """A hundred thousand bars: the join sees blocks, not all later bars of a level; rows as by a loop."""
    from pyspark.sql import functions as F

    n = 100_000
    bars = spark.range(n).select(F.lit("L").alias("symbol"), F.lit("1H").alias("tf"), F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(1000)) + F.floor(F.col("id") / 20000) * 150).cast("double").alias("close"))
    levels = bars.where("i % 97 = 0").select("symbol", "tf", F.col("i").alias("from_i"), (F.col("close") + 100).alias("level"))
    got = {r["from_i"]: r["j"] for r in structure._first_close_above(levels, bars, []).collect()}
    close = [r["close"] for r in bars.orderBy("i").collect()]
    want = {}
    for r in levels.collect():
        j = next((j for j in range(r["from_i"] + 1, n) if close[j] > r["level"]), None)
        if j is not None:
            want[r["from_i"]] = j
    assert got == want and len(want) > 500
