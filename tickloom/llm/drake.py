"""Centroid clustering in whole numbers, with adaptive bounds on distances.

Every vector keeps its centroid, lower bounds of its distances to some of the
next nearest ones, and one lower bound for all that remain.  When the centroids
move, each bound falls by what its centroid (for the remainder, the one that
moved most) has moved.  If the own distance is below all bounds, nothing has to
be looked at; if it is below all from some place on, only the centroids before
that place are; and if even the remainder's bound does not hold, all are.  How
many bounds are kept adapts to how far was looked.  The bounds save work only:
distances are whole numbers, bounds are rounded to the safe side, and a tie is
not certified, so the assignment is the one that all distances would give.

The vectors lie in a table with their bounds, written once a round.  The driver
holds the centroids and, a round, their exact sums, which tasks tell in limbs.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import Scratch, ship

#: Components below it (in size) have squared distances that fit 64 bits, at up to MOST_DIMS of them; others are Python's integers.
SMALL, MOST_DIMS = 1 << 27, 128
#: Bits of a limb of a sum: those of 2^22 tasks add up within 64 bits.
LIMB = 40
#: Whole numbers below it are doubles.
LARGEST = 1 << 1023
#: Vectors that are worked on together, and the share of them whose look fits the bounds that are kept.
ROWS, ENOUGH = 8192, 0.99


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit integers, or Python's where one is not SMALL.  A power of two scales without rounding."""
    with np.errstate(over="ignore"):
        y = np.floor(vectors * scale)
    if scale & (scale - 1) == 0 and vectors.shape[1] <= MOST_DIMS and (np.abs(y) < SMALL).all():
        return y.astype(np.int64)
    out = np.empty(vectors.shape, object)
    for at, x in np.ndenumerate(vectors):
        n, d = float(x).as_integer_ratio()
        out[at] = scale * n // d
    return out


def narrowed(centroids: list[list[int]]) -> np.ndarray:
    """Centroids as rows, of 64-bit integers if they are SMALL."""
    small = all(abs(v) < SMALL for c in centroids for v in c) and len(centroids[0]) <= MOST_DIMS
    return np.array(centroids, np.int64 if small else object).reshape(len(centroids), -1)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to rows (or to one)."""
    if x.dtype == object or c.dtype == object:
        x, c = x.astype(object), c.astype(object)
    d = x - c
    return (d * d).sum(1)


def _roots(x: np.ndarray, too_large: float) -> np.ndarray:
    """Square roots, rounded somehow."""
    if x.dtype != object:
        return np.sqrt(x.astype(np.float64))
    return np.array([float(v) if v < LARGEST else too_large for v in map(math.isqrt, x.ravel())]).reshape(x.shape)


def below(x: np.ndarray) -> np.ndarray:
    """Square roots that are not too large."""
    return np.maximum(_roots(x, sys.float_info.max) * (1 - 1e-12) - 1e-9, 0)


def above(x: np.ndarray) -> np.ndarray:
    """Square roots that are not too small."""
    with np.errstate(over="ignore"):
        return (_roots(x, np.inf) + (x.dtype == object)) * (1 + 1e-12) + 1e-9


def ordered(ids: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's centroids and distances by distance, ties by number."""
    by_id = np.argsort(ids, 1, kind="stable")
    ids, distances = np.take_along_axis(ids, by_id, 1), np.take_along_axis(distances, by_id, 1)
    order = np.argsort(distances, 1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(distances, order, 1)


@dataclass
class Bounds:
    """The state of some vectors: own centroid, next nearest ones with lower bounds, lower bound of the rest."""

    cluster: np.ndarray
    near: np.ndarray
    bound: np.ndarray
    rest: np.ndarray

    @classmethod
    def none(cls, n: int, keep: int) -> Bounds:
        return cls(np.zeros(n, np.int32), np.zeros((n, keep), np.int32), np.zeros((n, keep)), np.zeros(n))

    def scan(self, rows: np.ndarray, x: np.ndarray, centroids: np.ndarray) -> None:
        """All distances of *rows*, and their bounds anew."""
        k, keep = len(centroids), self.near.shape[1]
        d = np.stack([squared(x[rows], c[None]) for c in centroids], 1)
        ids, d = ordered(np.broadcast_to(np.arange(k, dtype=np.int32), d.shape), d)
        self.cluster[rows], self.near[rows] = ids[:, 0], ids[:, 1 : keep + 1]
        d = below(d)
        self.bound[rows] = d[:, 1 : keep + 1]
        self.rest[rows] = d[:, keep + 1] if keep + 1 < k else np.inf

    def move(self, x: np.ndarray, centroids: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """The assignment to *centroids*, which have moved by *shift* at most; how many bounds did not hold, a row."""
        keep = self.near.shape[1]
        self.bound = np.maximum(self.bound - shift[self.near], 0)
        # where no centroid remains, nothing moves
        self.rest = np.where(np.isinf(self.rest), np.inf, np.maximum(self.rest - shift.max(initial=0), 0))
        own = squared(x, centroids[self.cluster])
        # the least bound from a place on: beyond it nothing is nearer
        floors = np.minimum.accumulate(np.concatenate([self.bound, self.rest[:, None]], 1)[:, ::-1], 1)[:, ::-1]
        level = (floors <= above(own)[:, None]).sum(1)
        for n in np.unique(level[level > 0]).tolist():
            rows = np.flatnonzero(level == n)
            if n > keep:
                self.scan(rows, x, centroids)
                continue
            ids = np.concatenate([self.cluster[rows, None], self.near[rows, :n]], 1)
            d = np.stack([own[rows], *[squared(x[rows], centroids[ids[:, j]]) for j in range(1, n + 1)]], 1)
            ids, d = ordered(ids, d)
            self.cluster[rows], self.near[rows, :n], self.bound[rows, :n] = ids[:, 0], ids[:, 1:], below(d[:, 1:])
        return level

    def narrow(self, keep: int) -> None:
        """*keep* bounds from now on: those left out join the rest."""
        if self.near.shape[1] > keep:
            self.rest = np.minimum(self.rest, self.bound[:, keep:].min(1))
            self.near, self.bound = self.near[:, :keep], self.bound[:, :keep]


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Lists of *width* as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).copy()


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(np.ascontiguousarray(rows).ravel()))


def _pieces(batches: Iterator[pa.RecordBatch], scale: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            piece = batch.slice(lo, ROWS)
            yield piece, whole(_rows(piece.column("vec"), dim).astype(np.float64), scale)


def round_batches(centroids: list[list[int]], shift: list[float] | None, held: int, keep: int, scale: int):
    """(id, vec) in the first round, else with the state of *held* bounds, to the same with the state of *keep* bounds and the level of the look."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = narrowed(centroids)
        for piece, x in _pieces(batches, scale, c.shape[1]):
            if shift is None:
                state, level = Bounds.none(len(x), keep), np.full(len(x), keep + 1)
                state.scan(np.arange(len(x)), x, c)
            else:
                state = Bounds(piece.column("cluster").to_numpy().copy(), _rows(piece.column("near"), held), _rows(piece.column("bound"), held), piece.column("rest").to_numpy())
                level = state.move(x, c, np.array(shift))
                state.narrow(keep)
            cols = [piece.column("id"), piece.column("vec"), pa.array(state.cluster), _lists(state.near), _lists(state.bound), pa.array(state.rest), pa.array(level.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "vec", "cluster", "near", "bound", "rest", "level"])

    return run


def limbs(value: int) -> list[tuple[int, int]]:
    """(place, limb) of a whole number: limbs below 2^LIMB, with its sign."""
    sign, value, out, k = (-1 if value < 0 else 1), abs(value), [], 0
    while value:
        out.append((k, sign * (value & ((1 << LIMB) - 1))))
        value >>= LIMB
        k += 1
    return out


def sum_batches(k: int, dim: int, scale: int):
    """Vectors and clusters to (cluster, pos, limb, part): a task's sums; pos -1 counts the vectors, cluster -1 the levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count, levels = [[0] * dim for _ in range(k)], [0] * k, np.zeros(k + 2, np.int64)
        for piece, x in _pieces(batches, scale, dim):
            cluster = piece.column("cluster").to_numpy()
            levels += np.bincount(piece.column("level").to_numpy(), minlength=k + 2)
            for c in np.unique(cluster).tolist():
                mine = x[cluster == c]
                count[c] += len(mine)
                total[c] = [a + int(b) for a, b in zip(total[c], mine.sum(0), strict=True)]
        out = [(c, -1, 0, n) for c, n in enumerate(count) if n] + [(-1, n, 0, int(v)) for n, v in enumerate(levels) if v]
        out += [(c, p, place, part) for c in range(k) if count[c] for p, v in enumerate(total[c]) for place, part in limbs(v)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["cluster", "pos", "limb", "part"])

    return run


def distance_batches(centroids: list[list[int]], scale: int):
    """Vectors and clusters to (id, cluster, distance); null where it does not fit 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = narrowed(centroids)
        for piece, x in _pieces(batches, scale, c.shape[1]):
            d = squared(x, c[piece.column("cluster").to_numpy()])
            d = pa.array(d) if d.dtype != object else pa.array([int(v) if v < 1 << 63 else None for v in d], pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("cluster"), d], ["id", "cluster", "distance"])

    return run


@dataclass
class Clustering:
    """assigned: (id, cluster, distance) of every vector that takes part; centroids in whole numbers."""

    assigned: DataFrame
    centroids: list[list[int]]
    looked: list[dict[int, int]]  # a round: vectors by the number of bounds that did not hold


def clustered(vectors: DataFrame, seed_order: list[Column], *, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, keep: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> Clustering:
    """Clusters of the vectors of *dim* components, each taken as floor(scale * x).

    The centroids begin as the first *k* vectors by *seed_order* (nulls last,
    ties by the vector).  Each of *rounds* assigns every vector to the nearest
    centroid, by squared distance, ties to the smaller number, and makes each
    centroid that has vectors the floor of their mean; then vectors are assigned
    once more.  *keep* is the number of bounds to begin with, half of k if not given.

    * vectors that are null, of another length, or hold a null or non-finite
      component take no part; null ids are vectors like others;
    * fewer vectors than k: a centroid for each; repeated rows count each, and
      may be several centroids, of which the smaller number gets the vectors;
    * components of any size are exact; a distance beyond 64 bits is null;
    * an empty table gives an empty result; further columns are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    given = vectors.schema[vec_col].dataType.simpleString()
    kind = given if given in ("array<float>", "array<double>") else "array<double>"
    vec = F.col(f"`{vec_col}`").cast(kind)
    good = (F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(good, F.lit(False)))
    named = rows.select(F.col(f"`{id_col}`").alias("id"), vec.alias("vec"))
    id_kind = named.schema["id"].dataType.simpleString()
    first = rows.orderBy(*[c.asc_nulls_last() for c in seed_order], vec).limit(k).select(vec.alias("vec")).collect()
    if not first:
        return Clustering(spark.createDataFrame([], f"id {id_kind}, cluster int, distance long"), [], [])
    centroids = [[int(v) for v in row] for row in whole(np.array([list(r["vec"]) for r in first], np.float64), scale)]
    k = len(centroids)
    keep = min(k - 1, max(1, k // 2) if keep is None else keep)
    schema = f"id {id_kind}, vec {kind}, cluster int, near array<int>, bound array<double>, rest double, level int"
    looked, scratch = [], Scratch(spark)
    with scratch:
        state = scratch.put(named.mapInArrow(round_batches(centroids, None, keep, keep, scale), schema), "state0")
        for r in range(1, rounds + 1):
            told = state.select("vec", "cluster", "level").mapInArrow(sum_batches(k, dim, scale), "cluster int, pos int, limb int, part long").groupBy("cluster", "pos", "limb").agg(F.sum("part").alias("part")).collect()
            looked.append({t["pos"]: t["part"] for t in told if t["cluster"] < 0})
            count = {t["cluster"]: t["part"] for t in told if t["pos"] == -1}
            after = [[0] * dim if c in count else list(centroids[c]) for c in range(k)]
            for t in told:
                if t["cluster"] >= 0 and t["pos"] >= 0:
                    after[t["cluster"]][t["pos"]] += t["part"] << LIMB * t["limb"]
            after = [[v // count[c] for v in x] if c in count else x for c, x in enumerate(after)]
            if after == centroids:
                break  # nothing moves any more
            shift = above(squared(narrowed(after), narrowed(centroids))).tolist()
            # as many bounds as nearly all looks needed, if that is fewer
            held, need, n = keep, sum(looked[-1].values()) * ENOUGH, 0
            if r > 1:
                for level in range(held + 1):
                    n += looked[-1].get(level, 0)
                    if n >= need:
                        keep = min(held, max(1, level))
                        break
            centroids = after
            state = scratch.put(state.drop("level").mapInArrow(round_batches(centroids, shift, held, keep, scale), schema), f"state{r}")
            scratch.drop(f"state{r - 1}")
        assigned = scratch.keep(state.select("id", "vec", "cluster").mapInArrow(distance_batches(centroids, scale), f"id {id_kind}, cluster int, distance long"), "assigned")
    return Clustering(assigned, centroids, looked)
