"""Operators over one long series in many tasks: places without a global window, chunks that overlap.

An operator whose rows need at most some rows before and after them gives the
same result on a chunk that has those rows as well.  So a series is cut in
chunks of places, each with copies of its neighbours' nearest rows, every chunk
is a series of its own to the operator, and the copies' results are dropped.
Exponential and Wilder means need as many rows before as it takes the older ones
to weigh less than a double's precision (``fading``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.rolling import FADED, SERIES, running_sum


def placed(df: DataFrame) -> DataFrame:
    """Add i and n as ``rolling.indexed`` does, by blocks of seven days: rows are numbered in their block, from the number of those in the blocks before.

    A series of minutes has 10,080 rows a block.  The blocks are fixed by time,
    so that however often rows are read, they are dealt alike.
    """
    week = F.floor(F.unix_date(F.to_date("ts")) / 7)
    return running_sum(df, "i", F.lit(1).cast("long"), SERIES, week, ("ts",), total="n").withColumn("i", F.col("i") - 1)


def fading(decay: float) -> int:
    """Rows after which a recursion of *decay* has forgotten what was before."""
    if not 0 <= decay < 1:
        raise ValueError("a recursion that forgets has a decay from 0 to below 1")
    return 1 if decay == 0 else math.ceil(FADED / -math.log10(decay))


def in_chunks(df: DataFrame, operator: Callable[[DataFrame], DataFrame], rows: int, before: int, after: int = 0) -> DataFrame:
    """*operator* over *df* (with i and n), in chunks of *rows* places that see *before* and *after* rows of their neighbours.

    The operator works by (symbol, tf) and keeps i; each series is cut, however
    many there are.  Rows of its result are those of *df*'s rows.
    """
    if before > rows or after > rows:
        raise ValueError("a chunk sees no further than its neighbours")
    chunk, at = F.floor(F.col("i") / rows).cast("long"), F.pmod("i", F.lit(rows))
    copies = F.array_compact(F.array(chunk, F.when(at >= rows - before, chunk + 1) if before else F.lit(None).cast("long"), F.when((at < after) & (chunk > 0), chunk - 1) if after else F.lit(None).cast("long")))
    # a chunk is a series of its own
    each = df.withColumn("__chunk", F.explode(copies)).withColumn("symbol", F.concat_ws("\x1f", F.col("__chunk").cast("string"), "symbol"))
    out = operator(each.drop("__chunk"))
    own = F.substring_index("symbol", "\x1f", 1).cast("long") == chunk
    return out.where(own).withColumn("symbol", F.expr("substring(symbol, instr(symbol, '\x1f') + 1)"))
