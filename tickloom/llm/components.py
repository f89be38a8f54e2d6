"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.rows import HOT_ROWS, meet
from tickloom.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, component) for every endpoint of ``edges(a, b)``; the component is its least node.

    Each round every node hands its larger neighbours to its least neighbour
    (large star) and then its smaller ones (small star), which ends in
    O(log^2 n) rounds of group-bys and joins.  No neighbourhood is gathered in
    one row or task: minima are taken before the shuffle, and a hub's edges
    learn them from a broadcast (``rows.meet``).  Self
    loops and repeated edges are ignored; no edges give no rows.
    """
    now = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}-0")
    step, last, size = 0, None, now.count()
    while True:
        # so few edges make no hub
        join = (lambda left, right: left.join(right, "u")) if 2 * size <= HOT_ROWS else (lambda left, right: meet(left, right, "u", "d"))
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("d"))
        large = join(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        step += 1
        large = scratch.put(large, f"{tag}-{step}l")
        m = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = (
            join(large, m)
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        now = scratch.put(small, f"{tag}-{step}")
        n, total, most = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.max("u")).first()
        # done when nothing moved
        if (n, total, most) == last or n == 0:
            break
        last, size = (n, total, most), n
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
