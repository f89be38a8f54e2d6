"""The graph index against brute force."""

import numpy as np
import pytest

from tickloom.llm import graph_index, proximity
from tickloom.llm.graph_index import GraphIndex
from tickloom.llm.queries import op12_graph_search


def exact(rows, queries, k):
    """{query: [(vec_id, score)]} of rows (id, vector) by brute force; the sums go from the first component to the last."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    out = {}
    for q, v in queries:
        s = graph_index.inner(np.repeat(np.array(v, np.float64)[None], len(x), 0), x)
        own = (ids == q) & (x == np.array(v, np.float64)).all(1)
        order = [i for i in np.lexsort((ids, -s)) if not own[i]][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")


def test_query_recall(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = exact(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = found(op12_graph_search(spark, sf_dir))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.98
    scores = {(q, i): s for q, v in exact(rows, [r for r in rows if r[0] % 20 == 0], len(rows)).items() for i, s in v}
    assert all(s == scores[q, i] for q, v in got.items() for i, s in v)


@pytest.mark.parametrize("kind", ["clusters", "lengths"])
def test_many_shards_and_tiles(spark, monkeypatch, kind):
    """Shards, tiles of several shards and parts of the queries; a hot group of near copies, or inner products that go with the length."""
    monkeypatch.setattr(graph_index, "TILES", 2)
    monkeypatch.setattr(graph_index, "TILE_QUERIES", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    if kind == "clusters":
        x[:1000] = rng.normal(size=24) + rng.normal(size=(1000, 24)) * 0.02
        x[1000:1500] = 5 + rng.normal(size=(500, 24)) * 0.01
    else:
        x *= rng.lognormal(size=(3000, 1))
    x = x[rng.permutation(3000)].astype(np.float32)
    rows = list(zip(range(3000), x.tolist(), strict=True))
    queries = rows[::20]
    got = found(GraphIndex.build(frame(spark, rows), shard_rows=400).search(frame(spark, queries), 10))
    want = exact(rows, queries, 10)
    assert got.keys() == want.keys() and recall(got, want) >= 0.95


def test_copies_ties_and_few_candidates(spark):
    """A third of all rows are one vector: the least ids win; no vector is lost behind it."""
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (600, 8)).astype(float)
    x[:200] = [3, 3, 3, 3, 3, 3, 3, 3]
    rows = list(zip(range(600), x.tolist(), strict=True))
    rows += rows[:7]  # rows that repeat whole
    got = found(GraphIndex.build(frame(spark, rows), shard_rows=100_000).search(frame(spark, rows[:607:20]), 30))
    want = exact(rows[:600], rows[:600:20], 30)
    assert recall(got, want) > 0.97 and got[0] == want[0] and [i for i, _ in got[0]] == list(range(1, 31))
    few = found(GraphIndex.build(frame(spark, rows[300:305])).search(frame(spark, [rows[300], (7, rows[301][1])]), 20))
    assert len(few[300]) == 4 and len(few[7]) == 5


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1, 0]), (2, [0.5, 0.5]), (3, [-1, 0]), (20, [1, 1]), (40, [1, 2, 3]), (41, [3, 2, 1])]
    bad = [(4, None), (5, []), (6, [0, 0]), (7, [1, None]), (8, [nan, 1]), (60, [inf, 1]), (None, [1, 1]), (80, [-inf, 2])]
    df = frame(spark, good + bad).selectExpr("*", "1 as dim", "2 as shard", "'x' as id")
    got = found(GraphIndex.build(df).search(df.where("vec_id % 20 = 0"), 20))
    assert got == {20: [(1, 1.0), (2, 1.0), (3, -1.0)], 40: [(41, 10.0)]}
    twice = frame(spark, [(20, [1, 1]), (20, [2, 2])])
    assert sorted(tuple(r) for r in GraphIndex.build(twice).search(twice, 5).collect()) == [(20, 1, 20, 4.0), (20, 1, 20, 4.0)]
    assert GraphIndex.build(df.limit(0)).search(df, 3).count() == 0 and GraphIndex.build(df).search(df.limit(0), 3).count() == 0
    big = [(1, [1e30, 1.0]), (2, [1.0, 1e30]), (20, [1e30, 2e30])]
    wide = spark.createDataFrame(big, "vec_id long, embedding array<double>")
    assert [i for i, _ in found(GraphIndex.build(wide).search(wide.where("vec_id = 20"), 5))[20]] == [2, 1]


def test_every_node_is_reached():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(300, 16)) * 0.001 + rng.normal(size=16) * 50 for _ in range(30)])
    g = proximity.build(proximity.lifted(x), 16, 32, 1.2, 0)
    assert not len(proximity.unreached(g)) and (g.links >= 0).sum(1).min() > 0
    ids, near = proximity.search(g, proximity.asked(x[:1]), len(x))
    assert sorted(ids[0]) == list(range(len(x))) and (np.diff(near[0]) <= 0).all()
