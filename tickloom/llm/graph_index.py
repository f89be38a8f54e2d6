"""Approximate nearest neighbours by largest inner product: a robust-pruned directed graph a shard.

Vectors are dealt to shards by a hash, each with a graph (``proximity``) of its
distinct vectors, built in one task from ``shard_rows`` rows at most and kept as
a row of a table.  Queries meet shards in tiles: some shards and some thousand
queries at a time, so neither side is ever held whole by the driver or a task
and both travel once for each tile of the other.  A beam search of every shard
proposes vectors, whose inner products in double precision decide.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm import proximity
from tickloom.llm.rows import meet
from tickloom.llm.scratch import Scratch, ship

#: Queries of a tile, shards of a tile at most, and tiles of the shards from which on a tile has more than one.
TILE_QUERIES, TILE_SHARDS, TILES = 8192, 32, 64
#: Numbers of dimensions that are sent to every task.
SENT_DIMS = 10_000

SHARD = "dim int, shard int, ids array<long>, starts array<int>, wide boolean, vectors binary, points binary, degree int, links binary, entries array<int>"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dim) of the rows that take part: an id, components all known and finite, and one that is not 0."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))).withColumn("dim", F.size("vec"))


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Equally long lists as rows; no negative zeros."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0)]).reshape(-1, dim) + 0.0


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last."""
    out = np.zeros(len(a))
    with np.errstate(over="ignore", invalid="ignore"):
        for k in range(a.shape[1]):
            out += a[:, k] * b[:, k]
    return out


def shard_builder(degree: int, beam: int, alpha: float):
    def run(rows: pa.Table) -> pa.Table:
        dim, shard = rows["dim"][0].as_py(), rows["shard"][0].as_py()
        vectors, node = np.unique(matrix(rows["vec"], dim), axis=0, return_inverse=True)
        # rows that repeat whole are one
        pairs = np.unique(np.stack([node.ravel(), rows["id"].to_numpy()], 1), axis=0)
        starts = np.searchsorted(pairs[:, 0], np.arange(len(vectors) + 1))
        graph = proximity.build(proximity.lifted(vectors), degree, beam, alpha, shard)
        narrow = vectors.astype(np.float32)
        wide = bool((narrow != vectors).any())
        kept = [dim, shard, pairs[:, 1].tolist(), starts.tolist(), wide, (vectors if wide else narrow).tobytes(), graph.points.tobytes(), graph.links.shape[1], graph.links.tobytes(), graph.entries.tolist()]
        types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int32())]
        return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(kept, types, strict=True)], [c.split()[0] for c in SHARD.split(", ")])

    return run


def _best(query: np.ndarray, score: np.ndarray, vec_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first of each query, by score, then id."""
    order = np.lexsort((vec_id, -score, query))
    q = query[order]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    return order[rank < k]


def tile_searcher(k: int, beam: int):
    """Shards and queries of a tile to (query_id, query_no, vec_id, score), k of each query at most."""

    def run(shards: pa.Table, queries: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        if shards.num_rows and queries.num_rows:
            dim = shards["dim"][0].as_py()
            vecs, own = matrix(queries["vec"], dim), queries["id"].to_numpy()
            for s in range(shards.num_rows):
                row = {c: shards[c][s] for c in shards.column_names}
                ids, starts = (np.array(row[c].values) for c in ("ids", "starts"))
                exact = np.frombuffer(row["vectors"].as_buffer(), np.float64 if row["wide"].as_py() else np.float32).reshape(-1, dim)
                links = np.frombuffer(row["links"].as_buffer(), np.int32).reshape(-1, row["degree"].as_py())
                graph = proximity.Graph(np.frombuffer(row["points"].as_buffer(), np.float32).reshape(-1, dim + 1), links, np.array(row["entries"].values))
                for lo in range(0, len(vecs), proximity.BLOCK):
                    some = vecs[lo : lo + proximity.BLOCK]
                    nodes, _ = proximity.search(graph, proximity.asked(some), max(beam, k + 1))
                    q, c = np.nonzero(nodes >= 0)
                    node = nodes[q, c]
                    near = exact[node].astype(np.float64)
                    score, same = inner(some[q], near), (some[q] == near).all(1)
                    # of rows with one vector the least ids are ahead, and one may be the query's own
                    count = np.minimum(starts[node + 1] - starts[node], k + 1)
                    each = np.repeat(np.arange(len(q)), count)
                    vec_id = ids[np.repeat(starts[node] - (np.cumsum(count) - count), count) + np.arange(len(each))]
                    other = ~((vec_id == own[lo + q[each]]) & same[each])
                    each, vec_id = each[other], vec_id[other]
                    best = _best(q[each], score[each], vec_id, k)
                    found.append((lo + q[each[best]], score[each[best]], vec_id[best]))
        q, score, vec_id = (np.concatenate(x) for x in zip(*found, strict=True))
        best = _best(q, score, vec_id, k)
        at = pa.array(q[best])
        return pa.table({"query_id": queries["id"].take(at), "query_no": queries["no"].take(at), "vec_id": pa.array(vec_id[best]), "score": pa.array(score[best])})

    return run


class GraphIndex:
    """Graphs of all vectors of a table, by number of dimensions and shard."""

    def __init__(self, shards: DataFrame):
        self.shards = shards

    @classmethod
    def build(cls, vectors: DataFrame, *, shard_rows: int = 4096, degree: int = 24, beam: int = 64, alpha: float = 1.2, id_col: str = "vec_id", vec_col: str = "embedding") -> GraphIndex:
        """Index every vector of *vectors*: graphs of about *shard_rows* rows, of *degree* edges a node.

        * vectors that are null, empty, all zero, or hold a null or non-finite
          component take no part, nor do rows without an id;
        * vectors of different lengths are spaces of their own;
        * ties and repeated vectors are one node with all their ids, rows that repeat whole are one row;
        * very long vectors are worked on like others; further columns are ignored;
        * an empty table gives an index that finds nothing.
        """
        spark = vectors.sparkSession
        ship(spark)
        scratch = Scratch(spark)
        with scratch:
            rows = usable(vectors, id_col, vec_col)
            sizes = scratch.put(rows.groupBy("dim").agg(F.count("*").alias("n")), "sizes")
            sized = rows.join(F.broadcast(sizes), "dim") if sizes.count() <= SENT_DIMS else meet(rows, sizes, "dim", "n")
            dealt = sized.withColumn("shard", F.pmod(F.xxhash64("id", "vec"), F.ceil(F.col("n") / shard_rows)).cast("int"))
            # a task a shard, as far as hashes go
            n = sizes.agg(F.sum(F.ceil(F.col("n") / shard_rows))).first()[0] or 1
            dealt = dealt.select("dim", "shard", "id", "vec").repartition(int(n), "dim", "shard")
            return cls(scratch.keep(dealt.groupBy("dim", "shard").applyInArrow(shard_builder(degree, beam, alpha), SHARD), "shards"))

    def search(self, queries: DataFrame, k: int, *, beam: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """(query_id, rank, vec_id, score): the k nearest found of each query, nearest first, ties to the smaller id.

        A query is no candidate of its own (its id and vector); queries that
        repeat whole are one, those of one id with different vectors are ranked
        each for itself.  Which queries take part is as in ``build``.
        """
        # several shards a tile where there are many, so that few rows are ranked
        shards = self.shards.select("dim", "shard").groupBy("dim").agg(F.count("*").alias("n"))
        size = F.least(F.lit(TILE_SHARDS), F.greatest(F.lit(1), F.floor(F.col("n") / TILES)))
        tiles = shards.select("dim", size.cast("int").alias("size"), F.ceil(F.col("n") / size).cast("int").alias("tiles"))
        asked = usable(queries, id_col, vec_col).withColumn("no", F.xxhash64("vec")).dropDuplicates(["id", "no"])
        parts = max(1, math.ceil(asked.count() / TILE_QUERIES))
        asked = asked.withColumn("part", F.pmod(F.xxhash64("id", "no"), F.lit(parts)).cast("int"))
        # a few rows, one for each number of dimensions
        few = tiles.count() <= SENT_DIMS
        tiles = F.broadcast(tiles) if few else tiles
        left = self.shards.join(tiles, "dim").withColumn("tile", F.floor(F.col("shard") / F.col("size")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        right = asked.join(tiles, "dim").withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("dim", "tile", "part", "id", "no", "vec")
        keys = ["dim", "tile", "part"]
        found = left.drop("size", "tiles").groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile_searcher(k, beam), "query_id long, query_no long, vec_id long, score double")
        w = Window.partitionBy("query_id", "query_no").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
