"""Candles of a broker as a data source of Spark: a partition a series, parameters and filters go to the reader.

    register(spark, store)
    spark.read.format("candles").option("count", 200).option("end", "2025-01-01").load()

A scan reads the newest *count* bars of each (symbol, tf) that begin before
*end*, leaves out the last one, which is not complete, and gives nothing for a
series with too few bars.  Filters on symbol and tf leave out series before
anything is read, those on ts rows before they leave the reader.  A series that
cannot be read, or has too few bars, is tried again a few times, after an error
with a wait that doubles, and then has no rows: a scan goes on without it.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tickloom.config import DEFAULT, Config

PRICES = ("open", "high", "low", "close", "volume")
SCHEMA = "symbol string, tf string, ts timestamp_ntz, " + ", ".join(f"{c} double" for c in PRICES)
_COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


class Store:
    """What a reader asks; a broker's client has the same two methods and can be pickled."""

    def series(self) -> list[tuple[str, str]]:
        """All (symbol, tf)."""
        raise NotImplementedError

    def newest(self, symbol: str, tf: str, end: dt.datetime | None, count: int) -> pa.Table:
        """The newest *count* bars that begin before *end*: ts and prices, in any order."""
        raise NotImplementedError


@dataclass
class FolderStore(Store):
    """Bars as parquet in folders symbol=.../tf=..., which driver and executors see alike."""

    path: str

    def _dataset(self) -> ds.Dataset:
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(self.path)
        return ds.dataset(at, filesystem=where, format="parquet", partitioning=ds.partitioning(pa.schema([("symbol", pa.string()), ("tf", pa.string())]), flavor="hive"))

    def series(self) -> list[tuple[str, str]]:
        keys = (ds.get_partition_keys(f.partition_expression) for f in self._dataset().get_fragments())
        return sorted({(k["symbol"], k["tf"]) for k in keys})

    def newest(self, symbol: str, tf: str, end: dt.datetime | None, count: int) -> pa.Table:
        wanted = (pc.field("symbol") == symbol) & (pc.field("tf") == tf)
        if end is not None:
            wanted &= pc.field("ts") < pa.scalar(end, pa.timestamp("us"))
        rows = self._dataset().to_table(columns=["ts", *PRICES], filter=wanted)
        return rows.sort_by([("ts", "descending")]).slice(0, count)


@dataclass
class Series(InputPartition):
    symbol: str
    tf: str


class CandleReader(DataSourceReader):
    def __init__(self, store: Store, options: dict[str, str]):
        self.store = store
        self.count, self.attempts, self.wait = int(options.get("count", DEFAULT.fetch_bars)), int(options.get("attempts", 3)), float(options.get("wait", 1))
        self.end = dt.datetime.fromisoformat(options["end"]) if "end" in options else None
        self.least = json.loads(options.get("least", "{}"))
        self.of_key: list[Filter] = []
        self.of_time: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if name in ("symbol", "tf") and isinstance(f, (EqualTo, In)):
                self.of_key.append(f)
            elif name == "ts" and type(f) in _COMPARE:
                self.of_time.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        def asked(symbol: str, tf: str) -> bool:
            row = {"symbol": symbol, "tf": tf}
            return all(row[f.attribute[0]] in (f.value if isinstance(f, In) else (f.value,)) for f in self.of_key)

        return [Series(s, t) for s, t in self.store.series() if asked(s, t)]

    def fetched(self, symbol: str, tf: str) -> pa.Table | None:
        """The series' bars, oldest first, or none after the last attempt."""
        least = self.least.get(tf, 52)
        for attempt in range(self.attempts):
            try:
                rows = self.store.newest(symbol, tf, self.end, self.count)
            except Exception:  # whatever a client raises: the next attempt may do
                time.sleep(self.wait * 2**attempt if attempt + 1 < self.attempts else 0)
                continue
            if rows.num_rows >= least:
                return rows.sort_by("ts")
        return None

    def read(self, partition: Series) -> Iterator[pa.RecordBatch]:
        rows = self.fetched(partition.symbol, partition.tf)
        if rows is None:
            return
        rows = rows.slice(0, rows.num_rows - 1)
        for f in self.of_time:
            rows = rows.filter(_COMPARE[type(f)](rows["ts"], pa.scalar(f.value, pa.timestamp("us"))))
        key = lambda v: pa.array([v] * rows.num_rows, pa.string())
        table = pa.table({"symbol": key(partition.symbol), "tf": key(partition.tf), "ts": rows["ts"].cast(pa.timestamp("us")), **{c: rows[c].cast(pa.float64()) for c in PRICES}})
        yield from table.to_batches()


def register(spark: SparkSession, store: Store, name: str = "candles", config: Config = DEFAULT) -> str:
    """Make *store* readable as format *name*; bars a series needs at least are the roles' in *config* (option least: JSON by tf)."""
    known = json.dumps({t: m for t, _, _, m in config.roles})

    class Candles(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return CandleReader(store, {"least": known, **self.options})

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Candles)
    return name
