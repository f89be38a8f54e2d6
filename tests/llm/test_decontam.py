import random
import re

import duckdb
import numpy as np
import pyarrow as pa

from tickloom.llm import decontam
from tickloom.llm.decontam import contaminated, without_contaminated
from tickloom.llm.queries import OP5_SQL

ITEMS = [
    (1, "A train leaves Paris at 9 km from the old station and meets Anna after 45 minutes on the same track."),
    (2, "the quick brown fox jumps over the lazy dog near the river bank"),
    (3, "too short item"),
    (4, "six words make one short window"),
    (5, None),
    (6, ""),
    (None, "an item without id but with enough words in it to match"),
    (7, "If Tom has 3 apples and buys 5 apples then Tom has how many apples and 3 pears in all?"),
]
DOCS = [
    (10, "Intro words. A train leaves London at 12 km from the old station and meets Boris after 30 minutes on the same track. More."),
    (11, "THE QUICK brown fox jumps over the lazy dog near the river bank, as they say"),
    (12, "nothing of the kind is here at all, only other words in a row"),
    (13, "we say six words make one short window and go on"),
    (14, None), (15, ""),
    (16, "If Bob has 4 apples and buys 6 apples then Bob has how many apples and 4 pears in all?"),
    (17, "If Bob has 4 apples and buys 4 apples then Eve has how many apples and 9 pears in all?"),
    (18, "the quick brown fox " + "filler words go here " * 20000 + "the quick brown fox jumps over the lazy dog near the river bank"),
    (None, "the quick brown fox jumps over the lazy dog near the river bank"),
    (11, "THE QUICK brown fox jumps over the lazy dog near the river bank, as they say"),
]


def frames(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as win", "0 as id"), spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "2 as doc_id")


def test_templates_and_slots(spark):
    docs, items = frames(spark)
    got = {(r["doc_id"], r["item_id"]): r["verbatim"] for r in contaminated(docs, items).collect()}
    # 17 gives one number two values and one name two: no copy
    assert got == {(10, 1): False, (11, 2): True, (13, 4): True, (16, 7): False, (18, 2): True}


def test_filter_keeps_the_rest(spark):
    docs, items = frames(spark)
    left = without_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in left.collect()) == ["12", "14", "15", "17", "None"]


def test_empty(spark):
    docs, items = frames(spark)
    assert contaminated(docs.where("false"), items).count() == 0 and contaminated(docs, items.where("false")).count() == 0


def test_against_brute_force(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    words = lambda t: re.findall(r"\w+", t.lower())
    want = set()
    for item in items.collect():
        w = words(item["text"])
        windows = {tuple(w[i : i + 8]) for i in range(max(1, len(w) - 7))}
        for d in docs.collect():
            v = words(d["text"] or "")
            hit = windows & {tuple(v[i : i + 8]) for i in range(len(v) - 7)}
            if len(w) >= 8 and 2 * len(hit) >= len(windows):
                want.add((d["doc_id"], item["item_id"]))
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items).collect()} == want and want


def test_names_that_open_a_sentence_and_short_items(spark):
    items = [(1, "Tom has 3 apples and buys 5 more"), (2, "Tom has 5 apples. Anna gives him 3. How many apples does Tom have now?"), (3, "Name the capital"), (4, "seven words make one short window"), (5, "Yes")]
    docs = [
        (10, "Anna has 4 apples and buys 6 more"), (11, "Bob has 7 apples. Eve gives him 2. How many apples does Bob have now?"),
        (12, "Bob has 7 apples. Bob gives him 2. How many apples does Bob have now?"), (13, "name the capital"), (14, "Please name the capital of it"),
        (15, "Here. Tom has 3 apples and buys 5 more"), (16, "Every words make one short window"), (17, "Seven words make one short window"), (18, "Hello"), (19, "yes!"),
    ]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["verbatim"] for r in got.collect()} == {(10, 1): False, (11, 2): False, (13, 3): True, (15, 1): True, (17, 4): True, (19, 5): True}


def test_units_glued_to_numbers(spark):
    items = [(1, "A box of 3kg and a rope of 2.5 m go into the van with a 40km trip"), (2, "the 3rd man of 7kgs ran on to the gate")]
    docs = [
        (10, "A box of 5 kg and a rope of 1.25m go into the van with a 70 km trip"), (11, "A box of 3KG and a rope of 2.5m go into the van with a 40km trip"),
        (12, "A box of 5kg and a rope of 5m go into the van with a 70km trip"), (13, "the 3rd man of 7kgs ran on to the gate"), (14, "the 4th man of 8kgs ran on to the gate"), (15, "9kg"),
    ]
    documents, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = contaminated(documents, benchmark).collect()
    # 12 gives two numbers one value; what ends in no unit is a word
    assert {(r["doc_id"], r["item_id"]): (r["verbatim"], r["n_slots"]) for r in got} == {(10, 1): (False, 6), (11, 1): (True, 6), (13, 2): (True, 0)}
    con = duckdb.connect()
    con.register("documents", documents.toPandas())
    con.register("benchmark", benchmark.toPandas())
    assert sorted(con.execute(OP5_SQL).fetchall()) == sorted(tuple(r) for r in got)


def _maps(texts, width=8, least=5):
    batch = pa.record_batch({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    maps = [np.zeros(1 << 15, np.uint8) for _ in range(2)]
    for pages in decontam.map_batches(width, least, (18, 18))(iter([batch])):
        for r in pages.to_pylist():
            maps[r["which"]][r["page"] * decontam.PAGE :][: decontam.PAGE] |= np.frombuffer(r["bits"], np.uint8)
    windows = [k for b in decontam.item_batches(width, least)(iter([batch])) for k in b.column("win").to_pylist()]
    return maps, set(windows)


def test_readings_are_those_of_every_subset():
    rnd = random.Random(5)
    vocab = ["apple", "Tom", "Anna", "3", "kg", "river", "Bank", "goes"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", " ", "\n", ". "]) for _ in range(n))
    items = [text(12) for _ in range(10)] + ["\n".join(["Tom", "Anna", "River", "Bank", "Apple", "Goes", "Tom", "Anna", "River"])]
    maps, windows = _maps(items)
    long = text(3000) + "\n" + items[-1] + "\n" + items[0]
    got = decontam.hit_batches([m.tobytes() for m in maps], [8], 5)(iter([pa.record_batch({"id": pa.array([1], pa.int64()), "text": pa.array([long])})]))
    got = {(r["place"], r["win"]) for b in got for r in b.to_pylist() if r["win"] in windows}
    raw = np.frombuffer(long.encode(), np.uint8)
    canon, _, _, _, _, maybe = decontam.canonical(raw, np.array([0, len(raw)]))
    # without the map of beginnings every reading is followed
    every = decontam.readings(canon, maybe, np.full(len(canon), len(canon)), [8])
    want = {(p, k) for _, at, _, keys in every for p, k in zip(at.tolist(), keys.view(np.int64).tolist(), strict=True) if k in windows}
    assert got == want and len({p for p, _ in got}) > 5


def test_lists_of_capitalised_lines_follow_few_readings():
    rnd = random.Random(6)
    words = "the quick brown fox jumps over lazy dog near river bank says that Tom has three apples and buys five more".split()
    maps, _ = _maps([" ".join(rnd.choice(words) for _ in range(30)) for _ in range(100)])
    text = "\n".join(rnd.choice(words).capitalize() for _ in range(100_000))
    raw = np.frombuffer(text.encode(), np.uint8)
    canon, _, _, _, _, maybe = decontam.canonical(raw, np.array([0, len(raw)]))
    seen = []

    def begun(state):
        seen.append(len(state))
        return decontam._known(maps[1], state)

    assert maybe.all()
    list(decontam.readings(canon, maybe, np.full(len(canon), len(canon)), [8], begun))
    # twenty words make most pairs known; all subsets would be 254 beginnings a place
    assert sum(seen) < 24 * len(canon)


def test_hot_windows_of_a_large_benchmark(spark, monkeypatch):
    docs, items = frames(spark)
    want = sorted(contaminated(docs, items).collect())
    monkeypatch.setattr(decontam, "SMALL_WINDOWS", 0)
    meet = decontam.split_join
    monkeypatch.setattr(decontam, "split_join", lambda *args: meet(*args, limit=2))
    assert sorted(contaminated(docs, items).collect()) == want and want


def test_a_copied_list(spark):
    lines = "\n".join(["Apples", "Pears", "Anna", "Milk", "Bread", "Salt", "Rice", "Eggs", "Oil"])
    docs = spark.createDataFrame([(1, "Buy:\n" + lines + "\n" + "Cheese\n" * 50_000), (2, "Cheese\n" * 50_000)], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame([(7, lines)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["windows"], r["verbatim"], r["n_slots"]) for r in got] == [(1, 7, 2, True, 0)]


def test_short_items_inside_documents_by_parameter(spark):
    docs = spark.createDataFrame([(1, "Please name the capital of it"), (2, "it weighs 5 kg, they say"), (3, "neither of both")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Name the capital"), (2, "3 kg")], "item_id long, text string")
    assert contaminated(docs, items).count() == 0
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(docs, items, least=1).collect()} == {(1, 1), (2, 2)}
