"""The paper ledger as a table that streams write exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.ledger import LEDGER_A, log_signals, text_schema
from tickloom.sources.versions import VersionedTable


class LedgerTable:
    """Signals by id, each with the newest state that was written.

    Every change is a batch with a number: signals are logged once whoever sends
    them again, outcomes close the trades that are open, and a batch that is run
    again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = VersionedTable(spark, path, text_schema(LEDGER_A))

    def current(self, upto: int | None = None) -> DataFrame:
        """One row a signal, all columns text; as it was after batch *upto* if that is given."""
        return self.table.newest(["signal_id"], upto)

    def log(self, signals: DataFrame, batch: int) -> bool:
        """Append signals that are not known yet: OPEN, or BLOCKED where blocked_reason is given.

        Ids are those of the column signal_id, or hashes of the row where there
        is none; of several rows with one id in a batch the least is taken, null
        ids are left out.
        """
        empty = self.spark.createDataFrame([], text_schema(LEDGER_A))
        rows = log_signals(empty, signals)
        if "signal_id" in signals.columns:
            blocked = F.when(F.coalesce(F.col("blocked_reason") if "blocked_reason" in signals.columns else F.lit(""), F.lit("")) != "", "BLOCKED").otherwise("OPEN")
            given = signals.where("signal_id is not null").withColumn("status", blocked)
            rows = given.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in given.columns else F.lit("").alias(c) for c in LEDGER_A])
        once = rows.groupBy("signal_id").agg(F.min(F.struct(*[c for c in LEDGER_A if c != "signal_id"])).alias("r")).select("signal_id", "r.*").select(*LEDGER_A)
        known = self.current(batch - 1).select("signal_id")
        return self.table.commit(once.join(known, "signal_id", "left_anti"), batch)

    def close(self, outcomes: DataFrame, batch: int) -> bool:
        """Close open trades by (signal_id, status, exit_price, exit_ts, exit_reason, profit_pct); outcomes of others are left out."""
        told = outcomes.dropDuplicates(["signal_id"]).select(
            F.col("signal_id").cast("string").alias("signal_id"), F.col("status").alias("result"), F.col("exit_price").cast("string").alias("exit_price"), F.col("exit_ts").cast("string").alias("exit_time"),
            "exit_reason", F.col("profit_pct").cast("string").alias("profit_pct"),
        )
        new = [c for c in told.columns if c != "signal_id"]
        rows = self.current(batch - 1).where("status = 'OPEN'").drop(*new).join(told, "signal_id")
        return self.table.commit(rows.withColumn("status", F.col("result")).withColumns({c: F.coalesce(c, F.lit("")) for c in new}), batch)

    def compact(self, batch: int) -> bool:
        """The current rows as one version that replaces all before it."""
        return self.table.commit(self.current(batch - 1), batch, replaces=True)

    def follow(self, stream: DataFrame, checkpoint: str):
        """A writer of streaming rows: signals, and outcomes where the column outcome tells so.  A stream's batch is two of the table's."""

        def write(rows: DataFrame, batch: int) -> None:
            rows = rows.withColumn("outcome", F.coalesce("outcome", F.lit(False))) if "outcome" in rows.columns else rows.withColumn("outcome", F.lit(False))
            self.log(rows.where("not outcome"), 2 * batch + 1)
            if "status" in rows.columns:
                self.close(rows.where("outcome"), 2 * batch + 2)

        return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
