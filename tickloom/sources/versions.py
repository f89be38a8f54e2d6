"""Tables that streams write exactly once: a folder of rows a batch, and a log of commits.

A batch's rows are written to a folder of their own, which no reader knows, and
count from the moment its entry stands in the log: the entry is written aside
and renamed to the batch's number, which only the first writer can do.  So a
batch that failed half-way and is repeated leaves one copy, a batch that is
committed already does nothing, and a reader sees whole batches only, those of
the log at the time it looked.  A batch may replace all before it, which
switches the whole version at once.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Entry:
    batch: int
    folder: str
    replaces: bool


class VersionedTable:
    """Rows of one schema under *path*, in a file system that Spark's executors share and that renames atomically."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def entries(self) -> list[Entry]:
        """The log, in order of batches."""
        out = []
        for name in self._names("_log"):
            if not name.isdigit():
                continue  # an entry that is still aside
            stream = self._fs.open(self._path(f"{self.path}/_log/{name}"))
            try:
                told = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
            out.append(Entry(int(name), told["folder"], told["replaces"]))
        return sorted(out, key=lambda e: e.batch)

    def commit(self, rows: DataFrame, batch: int, replaces: bool = False) -> bool:
        """Write *rows* as batch number *batch*; false, and nothing is changed, if that is in the log already.

        A batch that replaces takes the place of all batches of smaller numbers.
        """
        entry = self._path(f"{self.path}/_log/{batch:020d}")
        if self._fs.exists(entry):
            return False
        folder = f"{batch:020d}-{uuid.uuid4().hex}"
        # a column the rows do not have is null
        typed = [(F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        rows.select(*typed).write.mode("error").parquet(f"{self.path}/{folder}")
        return self._enter(entry, {"folder": folder, "replaces": replaces})

    def _enter(self, entry, told: dict) -> bool:
        aside = self._path(f"{self.path}/_log/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, True)
        stream.write(bytearray(json.dumps(told).encode()))
        stream.close()
        # a rename onto what is there fails, or leaves it as it is
        done = not self._fs.exists(entry) and self._fs.rename(aside, entry)
        if not done:
            self._fs.delete(aside, False)
        return bool(done)

    def live(self, upto: int | None = None) -> list[Entry]:
        """The batches a reader sees (up to number *upto*): from the newest that replaces on."""
        seen = [e for e in self.entries() if upto is None or e.batch <= upto]
        first = max((k for k, e in enumerate(seen) if e.replaces), default=0)
        return seen[first:]

    def read(self, upto: int | None = None) -> DataFrame:
        """All rows of the batches in the log just now, with their number in __batch; no batches, no rows."""
        live = self.live(upto)
        if not live:
            return self.spark.createDataFrame([], T.StructType([*self.schema.fields, T.StructField("__batch", T.LongType())]))
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{e.folder}" for e in live])
        return rows.withColumn("__batch", F.regexp_extract(F.input_file_name(), r"/(\d{20})-[0-9a-f]{32}/", 1).cast("long"))

    def newest(self, keys: list[str], upto: int | None = None) -> DataFrame:
        """One row a key: that of its newest batch.  Rows of one key in one batch have to be alike; any of them is taken."""
        w = Window.partitionBy(*keys).orderBy(F.desc("__batch"))
        return self.read(upto).withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank", "__batch")

    def vacuum(self) -> list[str]:
        """Delete the folders no reader of the newest version reads, with rows of failed or replaced batches; their names."""
        live = {e.folder for e in self.live()}
        gone = [n for n in self._names("") if n not in live and not n.startswith("_")]
        for name in gone:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return gone
