"""First matches and histories over long series, without meeting every bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import DEFAULT, Config
from tickloom.functions.rolling import SERIES, lag

KEYS = list(SERIES)
#: Nodes of the tree of greatest closes that have one parent: bars, blocks of so many bars, blocks of so many blocks.
FANOUT = 512


def _tree(candles: DataFrame, depth: int) -> DataFrame:
    """(.., depth, parent, node, top): bars with their closes, and blocks with their greatest; the deepest blocks have one parent."""
    node = lambda c, d: F.floor(F.col(c) / F.lit(FANOUT**d)).cast("long")
    at = lambda d: F.struct(F.lit(d).alias("depth"), (node("i", d + 1) if d < depth else F.lit(0).cast("long")).alias("parent"), node("i", d).alias("node"))
    bars = candles.select(*KEYS, at(0).alias("at"), F.col("close").alias("top"))
    blocks = candles.select(*KEYS, "close", F.explode(F.array(*[at(d) for d in range(1, depth + 1)])).alias("at")).groupBy(*KEYS, "at").agg(F.max("close").alias("top"))
    return bars.unionByName(blocks).select(*KEYS, "at.*", "top")


def first_close_above(levels: DataFrame, candles: DataFrame, depth: int = 1) -> DataFrame:
    """Per level (series, from_i, level, other columns) the first later place j whose close is above it; levels without one are left out.

    In a tree of greatest closes a level meets the later siblings of its bar, of
    its block and so on; the least deep one that reaches it comes first, and
    then the children of that one, down to the bar.  So it meets FANOUT nodes a
    depth at most, up and down, but for the blocks without a parent, of which a
    series of n bars has n / FANOUT^depth: depth 1 is for series of some ten
    thousand bars, 2 for 10^8.  Every depth is a join more.
    """
    tree, names = _tree(candles, depth), levels.columns
    up = F.array(*[F.struct(F.lit(d).alias("depth"), (F.floor(F.col("from_i") / FANOUT ** (d + 1)) if d < depth else F.lit(0)).cast("long").alias("parent"), F.floor(F.col("from_i") / FANOUT**d).cast("long").alias("own")) for d in range(depth + 1)])
    hits = levels.withColumn("__u", F.explode(up)).select(*names, "__u.*").join(tree, [*KEYS, "depth", "parent"]).where((F.col("node") > F.col("own")) & (F.col("top") > F.col("level")))
    # the later siblings of a node come before those of its parent
    found = hits.groupBy(*names).agg(F.min(F.struct("depth", "node")).alias("m")).select(*names, "m.depth", "m.node")
    for d in range(depth, 0, -1):
        mine = F.col("depth") == d
        inside = found.where(mine).select(*names, F.col("node").alias("parent")).join(tree.where(F.col("depth") == d - 1), [*KEYS, "parent"]).where(F.col("top") > F.col("level"))
        found = found.where(~mine).unionByName(inside.groupBy(*names).agg(F.min("node").alias("node")).select(*names, F.lit(d - 1).alias("depth"), "node"))
    return found.select(*names, F.col("node").alias("j"))


def confirmed(swung: DataFrame, neighbours: int = 3) -> DataFrame:
    """Swing highs (.., from_i, level, known_i): a swing is known *neighbours* bars after it."""
    return swung.where("swing_high").select(*KEYS, F.col("i").alias("from_i"), F.col("high").alias("level"), (F.col("i") + neighbours).alias("known_i"))


def bos_history(swung: DataFrame, neighbours: int = 3, depth: int = 1) -> DataFrame:
    """(.., i, bos_index, broken_level, swing_high_index): what ``structure.bos_up`` would say after each bar.

    A break is an event that is valid from the later of its close and the bar
    its swing is confirmed by; of those valid the one with the newest close
    counts, ties to the oldest swing.  That only ever changes to a newer close,
    or an older swing of the same one, so a running maximum over the events in
    the order they become valid says it, with at least two swings confirmed.
    """
    highs = confirmed(swung, neighbours)
    hits = first_close_above(highs, swung, depth)
    valid = F.greatest("j", "known_i")
    event = F.struct(F.col("j").alias("j"), (-F.col("from_i")).alias("s"), F.col("level").alias("level"))
    events = hits.groupBy(*KEYS, valid.alias("i")).agg(F.max(event).alias("e"))
    known = highs.groupBy(*KEYS, F.col("known_i").alias("i")).agg(F.count("*").alias("k"))
    upto = Window.partitionBy(*KEYS).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = swung.select(*KEYS, "ts", "i").join(events, [*KEYS, "i"], "left").join(known, [*KEYS, "i"], "left")
    rows = rows.select(*KEYS, "ts", "i", F.max("e").over(upto).alias("e"), F.coalesce(F.sum("k").over(upto), F.lit(0)).alias("k"))
    return rows.where("e is not null and k >= 2").select(*KEYS, "ts", "i", F.col("e.j").alias("bos_index"), F.col("e.level").alias("broken_level"), (-F.col("e.s")).alias("swing_high_index"))


def gap_history(candles: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(.., i, fvg_index, fvg_low, fvg_high): what ``structure.fvg_up`` would say after each bar, on all bars up to it.

    A gap that opens at bar g is valid while no low has gone below its floor and
    it is young: from g to the bar before the first lower low, at most
    ``gap_age`` bars.  Every bar takes the newest gap whose time it lies in, so
    gaps meet the bars of their own time only.
    """
    floor, body, span = lag(F.col("high"), 2), lag(F.col("close")) - lag(F.col("open")), lag(F.col("high")) - lag(F.col("low"))
    df = candles.withColumns({"__floor": floor, "__body": body, "__span": span})
    size = (F.col("low") - F.col("__floor")) / F.nullif("__floor", F.lit(0.0))
    good = (F.col("i") > 2) & (F.col("__body") > 0) & (F.col("__span") != 0) & (F.col("__body") / F.nullif("__span", F.lit(0.0)) >= 0.6) & (F.col("low") > F.col("__floor")) & (size >= config.gap_least)
    gaps = df.where(good).select(*KEYS, F.col("i").alias("g"), F.col("__floor").alias("floor"), F.col("low").alias("top"))
    # after bar e there are e + 1 bars: a gap at g counts while g > e + 1 - gap_age
    alive = F.sequence(F.col("g"), F.col("g") + (config.gap_age - 2))
    lows = candles.select(*KEYS, "i", "low", "ts")
    each = gaps.withColumn("i", F.explode(alive)).join(lows, [*KEYS, "i"])
    so_far = F.min("low").over(Window.partitionBy(*KEYS, "g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    valid = each.withColumn("__least", so_far).where(F.col("__least") >= F.col("floor"))
    best = valid.groupBy(*KEYS, "i").agg(F.max_by(F.struct("g", "floor", "top", "ts"), "g").alias("m"))
    return best.select(*KEYS, "m.ts", "i", (F.col("m.g") - 1).alias("fvg_index"), F.round("m.floor", 4).alias("fvg_low"), F.round("m.top", 4).alias("fvg_high"))


def aligned(base: DataFrame, others: DataFrame, minutes: dict[str, int], value: str, base_tf: str) -> DataFrame:
    """Rows of *base_tf* with *value* of every other tf in *minutes* as it was known at the end of the row's bar.

    A bar counts from its end on: one ordered merge of all series of a symbol,
    the last value carried, no look ahead.  Columns are named value_tf.
    """
    end = lambda tf: F.col("ts") + F.make_dt_interval(mins=F.lit(minutes[tf]))
    rows = base.where(F.col("tf") == base_tf).select("symbol", "ts", end(base_tf).alias("at"), F.lit(1).alias("side"), *[F.lit(None).cast(others.schema[value].dataType).alias(f"{value}_{t.lower()}") for t in minutes])
    for tf in minutes:
        mine = others.where(F.col("tf") == tf).select("symbol", F.col("ts"), end(tf).alias("at"), F.lit(0).alias("side"), *[(F.col(value) if t == tf else F.lit(None).cast(others.schema[value].dataType)).alias(f"{value}_{t.lower()}") for t in minutes])
        rows = rows.unionByName(mine)
    upto = Window.partitionBy("symbol").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    carried = rows.select("symbol", "ts", "side", *[F.last(f"{value}_{t.lower()}", ignorenulls=True).over(upto).alias(f"{value}_{t.lower()}") for t in minutes])
    return carried.where("side = 1").drop("side")
