"""Candles from a stream of ticks: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, minutes: int, lateness: str = "10 minutes", tf: str | None = None) -> DataFrame:
    """Candles of a streaming frame (symbol, event_id, ts, price); a bar is emitted once the watermark has passed it.

    ``ts`` is made a timestamp with zone, as watermarks need; state is one row
    per open bar and symbol.  The last, incomplete bar is never emitted.
    """
    order = F.struct("ts", "event_id")
    return (
        ticks.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume"))
        .select("symbol", F.lit(tf or f"{minutes}m").alias("tf"), F.col("w.start").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")
    )
