import re

import numpy as np
import pyarrow as pa

from tickloom.llm.components import components
from tickloom.llm import minhash_dedup
from tickloom.llm.minhash_dedup import CELLS, blocks_of, close_pairs, histogram, near_duplicates, possible, verify_batches
from tickloom.llm.minhash_kernel import permute, scatter, shingle_hashes, signatures
from tickloom.llm.rows import meet, split_join
from tickloom.llm.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def brute(rows, num=85, den=100):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    least = {}  # sets whose least id is the same are one node
    for (i, _), s in zip(rows, sets, strict=True):
        if i is not None:
            least[frozenset(s)] = min(i, least.get(frozenset(s), i))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and least.get(frozenset(sets[a]), a) == least.get(frozenset(sets[b]), b) and None not in (rows[a][0], rows[b][0]):
                parent[find(a)] = find(b)
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        comp = min((rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and find(j) == find(k)), default=None) if i is not None and sets[k] else i
        out.append((i, len(sets[k]), comp, None if i is None else i == comp))
    return out


def test_signature_coordinates_are_shifts_of_one_permutation():
    raw = np.frombuffer(b"one two three four five six", np.uint8)
    s, b = shingle_hashes(raw, np.array([0, len(raw)]), 3)
    sig = signatures(s, b, 8)[0]
    slot = scatter((s >> np.uint64(32)).astype(np.uint32))
    for k in range(8):
        assert sig[k] == min(int(permute(np.array([(int(x) + k) % 2**32], np.uint32))[0]) for x in slot)


def test_permutations_are_one_to_one():
    x = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65537)
    assert len(np.unique(permute(x))) == len(x) == len(np.unique(scatter(x)))


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        words = [vocab[i] for i in rng.integers(0, 300, 60)]
        for copy in range(6):
            mine = list(words)
            for _ in range(copy):
                mine[rng.integers(0, 60)] = vocab[rng.integers(0, 300)]
            rows.append((base * 10 + copy, " ".join(mine)))
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "Only two"), (504, "only TWO"), (505, "É x y z"), (506, "é x y z"), (507, rows[0][1].upper()), (3, rows[3][1]), (3, rows[3][1]), (None, rows[0][1]), (508, "long " * 30000), (509, "long\n" * 30000), (600, rows[0][1]), (600, rows[12][1]), (600, ""), (700, "q " + rows[20][1]), (700, "q " + rows[30][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as n", "'x' as rep", "'y' as key", "0 as component_id")
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_every_text_of_a_repeated_pivot_is_verified(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"r{i}" for i in rng.integers(0, 10**6, 60)) for _ in range(6)]
    rows = [(k, t) for k in (1, 2) for t in texts[3 * k - 3 : 3 * k]]
    rows += [(10 * k + i, f"{t} e{k}{i}") for k in (1, 2) for i, t in enumerate(texts[3 * k - 3 : 3 * k])]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute(rows)) and {r[2] for r in got} == {1, 2}
    pair = pa.RecordBatch.from_pylist([{"a": 9, "b": 1, "h": h, "text_a": "one two three four", "text_b": t} for h, t in enumerate(("other words stand here", "one two three four"))])
    assert [b.num_rows for b in verify_batches(3, 85, 100)(iter([pair]))] == [1]


def test_empty_table(spark):
    out = near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"] and out.count() == 0


def test_large_group_of_near_copies_stays_exact(spark):
    rng = np.random.default_rng(2)
    words = [f"t{i}" for i in range(200)]
    rows = []
    for i in range(700):
        mine = list(words)
        for _ in range(int(rng.integers(0, 12))):
            mine[rng.integers(0, 200)] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(mine)))
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted(brute(rows))


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (3, 1), (7, 8), (8, 6), (6, 5)]
    with Scratch(spark) as s:
        got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), s, "t").collect()}
        none = components(spark.createDataFrame([], "a long, b long"), s, "u").count()
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 4} and none == 0
    chain = [(i, i + 1) for i in range(60)]
    with Scratch(spark) as s:
        assert {r["component"] for r in components(spark.createDataFrame(chain, "a long, b long"), s, "v").collect()} == {0}


def test_the_bound_never_rules_a_link_out():
    rng = np.random.default_rng(4)
    for n, share in ((30, 0.9), (400, 0.86), (9000, 0.85), (300_000, 0.85)):
        base = rng.integers(0, 2**63, n, dtype=np.uint64)
        other = base.copy()
        cut = int(n * (1 - share) / (1 + share))
        other[:cut] = rng.integers(0, 2**63, cut, dtype=np.uint64)
        a, b = np.unique(base), np.unique(other)
        both = len(np.intersect1d(a, b))
        ok, most = possible(histogram(b)[None], np.array([len(b)]), histogram(a), len(a), 85, 100)
        assert most[0] >= both and (ok[0] or 100 * both < 85 * (len(a) + len(b) - both))
    far = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, 300, dtype=np.uint64)
    assert not possible(histogram(far[0])[None], np.array([300]), histogram(far[1]), 300, 85, 100)[0][0]


def test_blocks_meet_every_pair_of_two_components_once(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "MAIN_BLOCK", 3)
    monkeypatch.setattr(minhash_dedup, "REST_BLOCK", 2)
    rows = [(k, k * 100 + i, c) for k in (1, 2, 3) for i, c in enumerate([7] * 8 + [5] * 4 + [9] * 3 * (k - 1) + [4] * (k == 2))] + [(4, i, 1) for i in range(5)]
    got = blocks_of(spark.createDataFrame(rows, "key long, rep long, comp long")).collect()
    assert {r["key"] for r in got} == {1, 2, 3}
    seen = []
    for block in {(r["key"], r["bi"], r["bj"]) for r in got}:
        mine = [r for r in got if (r["key"], r["bi"], r["bj"]) == block]
        cells = np.zeros((len(mine), CELLS), np.uint8)
        cells[:, 0] = 10
        t = {c: np.array([r[c] for r in mine]) for c in ("rep", "comp", "side")} | {"n": np.full(len(mine), 10), "keys": np.full((len(mine), 1), block[0]), "cells": cells}
        found, _ = close_pairs(t, block[0], block[1] != block[2], 85, 100, None)
        seen += [(block[0], *sorted((mine[i]["rep"], mine[j]["rep"]))) for i, j, _ in found]
    want = {(k, min(a, b), max(a, b)) for k, a, c in rows for j, b, d in rows if k == j and c != d and a != b}
    assert len(seen) == len(set(seen)) and set(seen) == want


def test_joins_of_hot_keys(spark):
    left = spark.createDataFrame([(k % 3 if k < 40 else k, k) for k in range(60)], "k long, v long")
    right = left.groupBy("k").count().where("k <> 59")
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, meet(left, right, "k", "count", 5).select("k", "v", "count").collect())) == want
    twice = right.unionByName(right)
    with Scratch(spark) as scratch:
        for limit in (4, 1000):
            got = split_join(left, twice, "k", scratch, f"s{limit}", limit).select("k", "v", "count").collect()
            assert sorted(map(tuple, got)) == sorted(want * 2)


def test_a_link_is_judged_by_its_own_text(spark):
    """Id 5 stands on a set of its own and on one whose least id is 2; only the latter is near id 7's."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(2, b), (5, a), (5, b), (7, b + " more"), (8, a + " " + b)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(2, 2), (5, 2), (5, 5), (7, 2), (8, 8)]
