"""Clustering with bounds against plain Lloyd rounds in whole numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import drake
from tickloom.llm.drake import clustered


def lloyd(rows, k, rounds, scale):
    """rows (id, vector) in order of their seeds; the assignment, distances and centroids."""
    x = [[math.floor(Fraction(float(v)) * scale) for v in r[1]] for r in rows]
    cents = [list(v) for v in x[:k]]
    for r in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cents] for v in x]
        own = [min(range(len(cents)), key=lambda c: (row[c], c)) for row in d]
        if r < rounds:
            for c in range(len(cents)):
                mine = [v for v, o in zip(x, own, strict=True) if o == c]
                if mine:
                    cents[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted((r[0], o, row[o]) for r, o, row in zip(rows, own, d, strict=True)), cents


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"vec_id long, embedding array<{kind}>")


@pytest.mark.parametrize(("spread", "keep"), [(0.02, None), (1.0, 1), (0.3, 6), (0.3, 0)])
def test_equals_plain_rounds(spark, spread, keep):
    rng = np.random.default_rng(int(spread * 100))
    x = rng.normal(size=(7, 5))[rng.integers(0, 7, 400)] + rng.normal(size=(400, 5)) * spread
    rows = list(zip(range(400), x.tolist(), strict=True))
    got = clustered(frame(spark, rows), [F.col("vec_id")], k=9, rounds=12, dim=5, keep=keep)
    want, cents = lloyd(rows, 9, 12, 1024)
    assert sorted(tuple(r) for r in got.assigned.collect()) == want and got.centroids == cents
    assert all(sum(r.values()) == 400 for r in got.looked)


def test_bounds_save_work(spark):
    """Once clusters have settled, most vectors are certified without a look at other centroids."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(8, 16))[rng.integers(0, 8, 2000)] + rng.normal(size=(2000, 16)) * 0.1
    got = clustered(frame(spark, list(zip(range(2000), x.tolist(), strict=True))), [F.col("vec_id")], k=8, rounds=10, dim=16)
    assert got.looked[-1].get(0, 0) > 1500


def test_ties_copies_and_empty_clusters(spark):
    """Seeds that are alike leave clusters empty, which stay; ties go to the smaller number."""
    rows = [(i, [v, 0.0]) for i, v in enumerate([1, 1, 1, 3, 5, 2, 2, 4, 4, -1, 7, 1, 1, 2])]
    got = clustered(frame(spark, rows), [F.col("vec_id")], k=5, rounds=6, dim=2, scale=4)
    want, cents = lloyd(rows, 5, 6, 4)
    assert sorted(tuple(r) for r in got.assigned.collect()) == want and got.centroids == cents


def test_components_of_any_size(spark):
    rows = [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [2e9, -3.0]), (3, [2.5e9, 0.1]), (4, [1e300, 5.0]), (5, [0.0, 0.0]), (6, [-0.3, 0.7])]
    got = clustered(frame(spark, rows), [F.col("vec_id")], k=3, rounds=5, dim=2, scale=1000)
    want, cents = lloyd(rows, 3, 5, 1000)
    assert sorted(tuple(r) for r in got.assigned.collect()) == [(i, c, d if d < 1 << 63 else None) for i, c, d in want] and got.centroids == cents
    values = [0, 1, -1, (1 << 40) - 1, 1 << 40, -(1 << 200) + 12345, 10**80]
    assert [sum(part << drake.LIMB * at for at, part in drake.limbs(v)) for v in values] == values
    assert drake.whole(np.array([[-0.0001, 1.5, 2.0**30]]), 1024).tolist() == [[-1, 1536, 1 << 40]]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1, 2]), (2, [3, 4]), (2, [3, 4]), (None, [9, 9])]
    bad = [(4, None), (5, []), (6, [1]), (7, [1, None]), (8, [nan, 1]), (9, [inf, 1]), (10, [1, 2, 3])]
    df = frame(spark, good + bad, "float").selectExpr("*", "1 as id", "2 as cluster", "'x' as vec")
    got = clustered(df, [F.col("vec_id")], k=4, rounds=3, dim=2, scale=2)
    assert sorted((str(r["id"]), r["cluster"], r["distance"]) for r in got.assigned.collect()) == [("1", 0, 0), ("2", 1, 0), ("2", 1, 0), ("None", 3, 0)]
    assert got.centroids == [[2, 4], [6, 8], [6, 8], [18, 18]]
    assert clustered(df.limit(0), [F.col("vec_id")], dim=2).assigned.count() == 0
    one = clustered(df, [F.col("vec_id")], k=1, rounds=2, dim=2, scale=2)
    assert {r["cluster"] for r in one.assigned.collect()} == {0} and one.centroids == [[8, 9]]
