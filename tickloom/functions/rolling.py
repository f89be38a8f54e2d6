"""Window functions with exact warm-up, and linear recursions over ordered rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERIES = ("symbol", "tf")
#: Powers of ten that a decay falls by over one block of ``recursions``, and may fall by at most.
FADED, MOST = 20, 280
#: Rows a task of ``running_sum`` is to sort, and those it sorts at most on average, if their number is known.
TASK_ROWS, MOST_ROWS = 1 << 18, 1 << 20


def series() -> Window:
    return Window.partitionBy(*SERIES).orderBy("ts")


def back(n: int) -> Window:
    """The current row and the n - 1 before it."""
    return series().rowsBetween(-(n - 1), 0)


def full(value: Column, x: Column, n: int) -> Column:
    """*value* where the last n rows all have x, else null."""
    return F.when(F.count(x).over(back(n)) == n, value)


def rolling_mean(x: Column, n: int) -> Column:
    return full(F.avg(x).over(back(n)), x, n)


def rolling_sum(x: Column, n: int) -> Column:
    return full(F.sum(x).over(back(n)), x, n)


def rolling_std(x: Column, n: int, population: bool = False) -> Column:
    return full((F.stddev_pop if population else F.stddev_samp)(x).over(back(n)), x, n)


def lag(x: Column | str, n: int = 1) -> Column:
    return F.lag(x, n).over(series())


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return a / F.nullif(b, F.lit(0.0))


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where not or unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def fill_back(x: Column) -> Column:
    """The next known value at or after the row, else 0.

    It is the last known one of the series read backwards, in one pass; a window
    from the row to the end is read anew for every row.
    """
    backwards = Window.partitionBy(*SERIES).orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(x, ignorenulls=True).over(backwards), F.lit(0.0))


def q6(x: Column) -> Column:
    """Rounded to six digits, without a negative zero."""
    return F.round(x * 1_000_000).cast("long").cast("double") / 1_000_000


def indexed(df: DataFrame) -> DataFrame:
    """Add i, the row's place in its series from 0, and n, the series' length."""
    return df.withColumn("i", F.row_number().over(series()).cast("long") - 1).withColumn("n", F.count("*").over(Window.partitionBy(*SERIES)))


def tasks_for(spark: SparkSession, count: int) -> int:
    """Partitions for *count* rows (0 if unknown): Spark's setting, and more where a task would have more than TASK_ROWS.

    Spark writes to as many partitions as its bypass threshold without sorting;
    for more of them a reader sorts all it has read, so the threshold is passed
    only where a task would have more than MOST_ROWS.
    """
    bypass = int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(math.ceil(count / TASK_ROWS), bypass), math.ceil(count / MOST_ROWS))


def running_sum(df: DataFrame, name: str, x: Column, keys: tuple[str, ...], block: Column, order: tuple[str, ...], total: str | None = None, count: int = 0) -> DataFrame:
    """Add *name*, the running sum of whole numbers x per *keys* by *order*, and *total*, their sum, with a window a block in place of one a series.

    *block* never falls along *order*.  What the blocks before sum to opens a
    block as a row of its own, so rows are shuffled once and nothing is joined.
    One task a series sums its blocks, a row each.  Blocks are dealt over all
    shuffle partitions, which are not merged: a task sorts its rows, and merged
    ones hold 64 MB of compressed bytes, several times that in memory.  With
    *count*, the rows there are at most, partitions grow with them (``tasks_for``).
    """
    rows = df.withColumns({"__block": block, "__x": x, "__own": F.lit(1)})
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "__block").agg(F.sum("__x").alias("__sum"))
    opening = sums.select(*keys, "__block", F.sum("__sum").over(before).alias("__x"), F.lit(0).alias("__own"), *([F.sum("__sum").over(Window.partitionBy(*keys)).alias("__total")] if total else []))
    inside = Window.partitionBy(*keys, "__block").orderBy("__own", *order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = rows.unionByName(opening, allowMissingColumns=True).repartition(tasks_for(df.sparkSession, count), *keys, "__block")
    both = dealt.withColumns({name: F.sum("__x").over(inside)} | ({total: F.first("__total").over(inside)} if total else {}))
    return both.where("__own = 1").drop("__block", "__x", "__own", "__total")


def blocks_for(decays: dict[str, float]) -> list[tuple[int, list[str]]]:
    """(rows of a block, names): decays strictly between 0 and 1 that share one length of blocks.

    Over a block every decay falls by 10^FADED at least, so the block before is
    all that a double still sees, and by 10^MOST at most, so its powers are doubles.
    """
    out: list[tuple[int, list[str]]] = []
    for name in sorted(decays, key=lambda k: -decays[k]):
        fall = -math.log10(decays[name])
        if out and out[-1][0] * fall <= MOST:
            out[-1][1].append(name)
        else:
            out.append((math.ceil(FADED / fall), [name]))
    return out


def recursions(df: DataFrame, terms: dict[str, tuple[Column, float]]) -> DataFrame:
    """Add each name: y(i) = decay * y(i - 1) + term(i), y(-1) = 0, over rows with place i.

    Within a block of rows this is a prefix sum of terms scaled by powers of the
    decay; a block's value at its end is all that the next one needs, as blocks
    are as long as it takes earlier ones to weigh less than the precision of a
    double.  No series is gathered in an array.  Null terms count as 0.  Decay 0
    is the term, decay 1 the running sum.  Recursions whose decays allow blocks
    of one length share their windows.
    """
    upto = series().rowsBetween(Window.unboundedPreceding, -1)
    terms = {k: (F.coalesce(t, F.lit(0.0)), d) for k, (t, d) in terms.items()}
    flat = {k: t if d == 0 else F.sum(t).over(series().rowsBetween(Window.unboundedPreceding, 0)) for k, (t, d) in terms.items() if d in (0, 1)}
    for k, (_, d) in terms.items():
        if not 0 <= d <= 1:
            raise ValueError(f"decay of {k} is {d}, not within 0 and 1")
    df = df.withColumns({f"__v_{k}": t for k, (t, _) in terms.items() if k not in flat} | flat)
    for rows, names in blocks_for({k: d for k, (_, d) in terms.items() if k not in flat}):
        decay = {k: F.lit(terms[k][1]) for k in names}
        inner = Window.partitionBy(*SERIES, "__block").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({"__block": F.floor(F.col("i") / rows), "__r": F.pmod(F.col("i"), F.lit(rows)).cast("double")})
        df = df.withColumns({f"__t_{k}": F.col(f"__v_{k}") * F.pow(decay[k], -F.col("__r")) for k in names})
        df = df.withColumns({f"__p_{k}": F.pow(decay[k], F.col("__r")) * F.sum(f"__t_{k}").over(inner) for k in names})
        ends = {k: F.last(F.when(F.col("__r") == rows - 1, F.col(f"__p_{k}")), ignorenulls=True).over(upto) for k in names}
        df = df.withColumns({k: F.col(f"__p_{k}") + F.coalesce(F.pow(decay[k], F.col("__r") + 1) * ends[k], F.lit(0.0)) for k in names})
        df = df.drop("__block", "__r", *[f"__{x}_{k}" for k in names for x in "vtp"])
    return df


def ewm(df: DataFrame, alphas: dict[str, tuple[Column, float]]) -> DataFrame:
    """Exponential means without adjustment, name: (x, alpha); y(0) = x(0), then (1 - alpha) y + alpha x; x known throughout."""
    return recursions(df, {k: (F.when(F.col("i") == 0, x).otherwise(a * x), 1 - a) for k, (x, a) in alphas.items()})


def ewm_from(df: DataFrame, name: str, x: Column, alpha: float, start: int) -> DataFrame:
    """``ewm`` of the rows from place *start* on; null before."""
    df = recursions(df, {name: (F.when(F.col("i") == start, x).when(F.col("i") > start, alpha * x), 1 - alpha)})
    return df.withColumn(name, F.when(F.col("i") >= start, F.col(name)))


def wilder(df: DataFrame, columns: dict[str, Column], n: int, start: int, total: bool = False) -> DataFrame:
    """Wilder smoothing, name: x; the mean (sum) of the n values up to place *start*, then y (n-1)/n + x/n (+ x); null before."""
    df = df.withColumns({f"__seed_{k}": (F.sum(x) if total else F.avg(x)).over(back(n)) for k, x in columns.items()})
    gain = 1.0 if total else 1.0 / n
    df = recursions(df, {k: (F.when(F.col("i") == start, F.col(f"__seed_{k}")).when(F.col("i") > start, x * gain), (n - 1) / n) for k, x in columns.items()})
    return df.withColumns({k: F.when(F.col("i") >= start, F.col(k)) for k in columns}).drop(*[f"__seed_{k}" for k in columns])
