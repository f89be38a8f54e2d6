"""The price walk of the fixture and places of long series in blocks: the same sums, spread over tasks."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import chunks, rolling
from tickloom.sources import market


@pytest.fixture
def as_dealt(spark):
    """Partitions as they are dealt, none merged."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_no_task_holds_a_symbol(as_dealt, sf_dir):
    ticks = market.ticks(as_dealt, sf_dir)
    tasks = ticks.where("symbol = 'ALL'").groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("rows"), F.max("price")).collect()
    rows = sum(r["rows"] for r in tasks)
    assert rows == market.table(as_dealt, sf_dir, "events").count()
    assert len(tasks) > 1 and max(r["rows"] for r in tasks) < 0.5 * rows


def test_blocks_are_not_merged(spark, sf_dir):
    """Adaptive execution merged the blocks of small shuffles into one task, and those of large ones to 64 MB of compressed bytes."""
    tasks = market.ticks(spark, sf_dir).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_running_sum_is_the_whole_window(spark):
    t0, rows = dt.datetime(2024, 1, 1), []
    for k in range(400):
        symbol = ("A", "B", None)[k % 3]
        at = None if k % 53 == 0 else t0 + dt.timedelta(minutes=(k * 37) % 900 // 5 * 5)
        rows.append((symbol, k, at, None if k % 11 == 0 or k % 3 == 1 and at and at.hour < 2 else (k * 7919) % 101 - 50))
    df = spark.createDataFrame(rows, "symbol string, k long, ts timestamp_ntz, x long")
    whole = Window.partitionBy("symbol").orderBy("ts", "k").rowsBetween(Window.unboundedPreceding, 0)
    got = rolling.running_sum(df, "y", F.col("x"), ("symbol",), F.hour("ts"), ("ts", "k"))
    assert got.columns == [*df.columns, "y"]
    assert sorted(map(str, got.collect())) == sorted(map(str, df.withColumn("y", F.sum("x").over(whole)).collect()))


def test_places_do_not_hang_on_samples(spark):
    """Places were numbered over ranges that were sampled anew for each reading, so that rows of long series got wrong places or were lost."""
    t0 = dt.datetime(2025, 1, 6)
    df = spark.createDataFrame([(s, "1H", t0 + dt.timedelta(hours=(k * 7) % 900)) for s in ("A", "B", None) for k in range(900)], "symbol string, tf string, ts timestamp_ntz").repartition(5)
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", "2")
    try:
        got = chunks.placed(df).select("symbol", "ts", "i", "n").collect()
    finally:
        spark.conf.unset("spark.sql.execution.rangeExchange.sampleSizePerPartition")
    assert sorted(map(str, got)) == sorted(map(str, rolling.indexed(df).select("symbol", "ts", "i", "n").collect()))


def test_tasks_of_the_walk_grow_with_the_events(as_dealt, sf_dir, monkeypatch):
    """The walk had as many tasks as there are shuffle partitions whatever the input, so that with few of them a task's memory followed it."""
    rows, few = 2 * market.table(as_dealt, sf_dir, "events").count(), int(as_dealt.conf.get("spark.sql.shuffle.partitions"))
    whole = sorted(map(str, market.ticks(as_dealt, sf_dir).collect()))
    monkeypatch.setattr(rolling, "TASK_ROWS", rows // (8 * few), raising=False)
    ticks = market.ticks(as_dealt, sf_dir)
    assert 8 * few <= ticks.rdd.getNumPartitions() <= 8 * few + 8
    assert sorted(map(str, ticks.collect())) == whole


def test_tasks_for_a_count(as_dealt):
    few = int(as_dealt.conf.get("spark.sql.shuffle.partitions"))
    assert [rolling.tasks_for(as_dealt, n) for n in (0, 1, few * rolling.TASK_ROWS, few * rolling.TASK_ROWS + 1)] == [few, few, few, few + 1]
    # up to the threshold Spark writes without sorting; beyond it a task's rows are bounded still
    assert rolling.tasks_for(as_dealt, 200 * rolling.MOST_ROWS) == 200
    assert rolling.tasks_for(as_dealt, 300 * rolling.MOST_ROWS) == 300
