"""Bars that late ticks revise: a watermark drops nothing here.

Every batch of ticks is kept, by day, in a versioned table.  The bars a batch
touches are made anew from all ticks of them, each counted once by its id, and
written as a revision of the same batch; a bar is its newest revision.  A batch
reads the days it touches only, so the cost of a late tick is its day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources import market
from tickloom.sources.versions import VersionedTable

TICKS = "symbol string, event_id long, ts timestamp_ntz, price double, day date"
BARS = "symbol string, tf string, ts timestamp_ntz, open double, high double, low double, close double, volume double"


class RevisedBars:
    """Bars of one length (at most a day) under *path*: ``revise`` with each batch, ``bars`` as they are now."""

    def __init__(self, spark: SparkSession, path: str, minutes: int, tf: str | None = None):
        if not 0 < minutes <= 1440 or 1440 % minutes:
            raise ValueError("a bar lies within one day")
        self.minutes, self.tf = minutes, tf
        self.ticks = VersionedTable(spark, f"{path}/ticks", TICKS)
        self.revisions = VersionedTable(spark, f"{path}/bars", BARS)

    def revise(self, ticks: DataFrame, batch: int) -> bool:
        """Take in (symbol, event_id, ts, price) as *batch*; false if that was done before.

        Ticks without symbol, id or time are left out.  Of a tick that is sent
        again the first batch's price stands, within a batch the least.
        """
        if any(e.batch == batch for e in self.revisions.entries()):
            return False
        new = ticks.where("symbol is not null and event_id is not null and ts is not null").select("symbol", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "price")
        self.ticks.commit(new.withColumn("day", F.to_date("ts")), batch)
        known = self.ticks.read(upto=batch)
        mine = known.where(F.col("__batch") == batch)
        touched = mine.select("symbol", market.bucket(F.col("ts"), self.minutes).alias("bar")).distinct()
        # the days go to the scan of each batch's files, whose least and greatest day tell which are read
        span = mine.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
        near = known.where(F.col("day").between(F.lit(span["a"]), F.lit(span["b"]))).withColumn("bar", market.bucket(F.col("ts"), self.minutes))
        once = near.join(touched, ["symbol", "bar"], "left_semi").groupBy("symbol", "event_id").agg(F.min_by(F.struct("ts", "price"), F.struct("__batch", "price", "ts")).alias("t"))
        return self.revisions.commit(market.bars(once.select("symbol", "event_id", "t.ts", "t.price"), self.minutes, self.tf), batch)

    def bars(self, upto: int | None = None) -> DataFrame:
        """The bars after all batches, or as they were after batch *upto*."""
        return self.revisions.newest(["symbol", "tf", "ts"], upto)

    def follow(self, stream: DataFrame, checkpoint: str):
        """A writer of streaming ticks to this table; a batch that is run again after a failure changes nothing."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.revise(rows, batch) and None).option("checkpointLocation", checkpoint)
