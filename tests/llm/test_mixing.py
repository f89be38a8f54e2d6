import math
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tickloom.llm.mixing import mixed_rows, mixture, source_targets, split_tree


def targets(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """Sharing by hand: cap, hand out the excess by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    pool, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = pool / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
            pool -= out[s]
        open_ -= over
    return out


def test_targets(spark):
    for sizes in ({"a": 100, "b": 5, "c": 40, None: 7}, {"a": 10}, {"z": 0, "y": 0}, {f"s{i}": (i * 37) % 91 for i in range(23)}):
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, docs long")
        got = {r["source"]: r["target"] for r in source_targets(df).collect()}
        want = targets(sizes)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in got)


def test_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixture(docs).collect()
    assert len(rows) == docs.count()
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]] or "")) and 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * len(r["draws"])
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = targets(size)
    for s in size:
        assert math.isclose(target[s], want[s], rel_tol=1e-9) and abs(taken[s] - target[s]) <= max(40, 0.02 * target[s])
    again = mixture(docs.repartition(7)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    flat = mixed_rows(docs, ("doc_id", "text", "source"))
    assert flat.count() == sum(len(r["draws"]) for r in rows)


def test_tree_splits_quotas_like_cards(spark):
    quotas = {0: 40, 1: 0, 2: 24, 3: 64}
    seen = defaultdict(list)
    for seed in range(12):
        rows = split_tree(spark.createDataFrame(list(quotas.items()), "rank long, quota long"), 4, seed).collect()
        per = defaultdict(int)
        for r in rows:
            per[r["rank"]] += r["draws"]
            assert r["draws"] >= 0
            seen[r["rank"]].append(r["draws"])
        assert per == quotas
        assert {sum(r["draws"] for r in rows if r["shard"] == k) for k in range(4)} == {32}
    # mean quota / 4; variance of the hypergeometric distribution
    for rank, q in quotas.items():
        mean = sum(seen[rank]) / 48
        var = sum((x - mean) ** 2 for x in seen[rank]) / 48
        want = 32 * (q / 128) * (1 - q / 128) * 96 / 127
        assert mean == q / 4 and (want == 0 or 0.4 * want < var < 2.2 * want)


def test_odd_shards(spark):
    rows = split_tree(spark.createDataFrame([(0, 10), (1, 5)], "rank long, quota long"), 3, 1).collect()
    assert sorted(sum(r["draws"] for r in rows if r["shard"] == k) for k in range(3)) == [5, 5, 5]


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "d e", None), (None, "f g h i", "y"), (5, "w " * 50000, "z")]
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as h", "2 as size", "3 as rank", "4 as block", "5 as draws", "6 as target")
    got = mixture(df).collect()
    assert len(got) == 7 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixture(df.where("false")).count() == 0
    assert {r["taken"] for r in mixture(df.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}


def test_plan_is_native(spark, sf_dir):
    plan = mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_shards_are_dealt_and_shuffled_locally(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixed_rows(docs, ("doc_id", "source"), shards=4).withColumn("p", F.spark_partition_id()).select("p", "shard", "local_key", "source").collect()
    homes = defaultdict(set)
    for p in {r["p"] for r in rows}:
        mine = [(r["shard"], r["local_key"]) for r in rows if r["p"] == p]
        assert mine == sorted(mine)
    for r in rows:
        homes[r["shard"], (r["local_key"] + (1 << 63)) >> 58].add(r["p"])
    assert all(len(v) == 1 for v in homes.values()) and len({r["shard"] for r in rows}) == 4
    # neighbours in a shard come from different sources about as often as chance has it
    shard = [r["source"] for r in sorted((r for r in rows if r["shard"] == 0), key=lambda r: r["local_key"])]
    same = sum(a == b for a, b in zip(shard, shard[1:], strict=False)) / (len(shard) - 1)
    chance = sum((shard.count(s) / len(shard)) ** 2 for s in set(shard))
    assert abs(same - chance) < 0.15
