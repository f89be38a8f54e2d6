"""Tables that cut lineage, in the folder all executors share.

``spark.checkpoint.dir`` names that folder on a cluster and is read from the
session; only where it is unset (tests, one machine) is a local one made.  A
written table survives the loss of executors and is pruned by column when it is
read again, which is why operators use it instead of caching.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_left: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; made only if the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _left:
        try:
            remove(spark, path)
        except Exception:  # the session has ended; the folder's owner clears it
            return


atexit.register(_sweep)


class Scratch:
    """Written tables of one operator call.

    ``keep`` writes what the result still reads (removed when Python ends),
    ``put`` what only the call itself needs (removed when the block ends).
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/tickloom-{uuid.uuid4().hex}"
        self.known: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for known in self.known:
            self.spark.sql(f"DROP TABLE IF EXISTS {known}")
        remove(self.spark, f"{self.base}/tmp")

    def _write(self, df: DataFrame, path: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        return self._write(df, f"{self.base}/tmp/{name}")

    def bucketed(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """``put``, in as many buckets of *key* as a shuffle has partitions, so that joins on it leave the table where it is.

        The table is known to the session under a name of its own until the block ends.
        """
        path, known = f"{self.base}/tmp/{name}", f"{name}_{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.mode("overwrite").format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(known)
        self.known.append(known)
        return self.spark.table(known)

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.base}/tmp/{name}")

    def forget(self, name: str) -> None:
        remove(self.spark, f"{self.base}/kept/{name}")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/kept/{name}"
        if not _left or _left[-1][1] != self.base:
            _left.append((self.spark, self.base))
        return self._write(df, path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package once per application, whatever their Python path holds."""
    import os
    import zipfile

    import tickloom

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(tickloom.__file__)))
    place = os.path.join(tempfile.mkdtemp(prefix="tickloom-ship-"), "tickloom.zip")
    with zipfile.ZipFile(place, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "tickloom")):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(place)
    _shipped.add(app)
