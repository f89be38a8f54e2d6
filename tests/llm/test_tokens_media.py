import hashlib
import random
import zlib

import numpy as np
from pyspark.sql.pandas.types import from_arrow_schema

from tickloom.llm import media_chunks as media
from tickloom.llm.scratch import Scratch
from tickloom.llm.token_counts import LEAF, Tree, apply_edits, build_trees, tokenizer


def test_edits_equal_a_full_count(spark, sf_dir):
    find, count = tokenizer(None, None)
    rng = random.Random(4)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    redone = total = 0
    for t in texts:
        t = (t or "")[: rng.choice([0, 3, 40, 400, 20000])]
        tree = Tree.build(t, find, count)
        for _ in range(5):
            a = rng.randint(0, len(t))
            t, n = tree.edit(t, a, a + rng.choice([0, 1, 5, 60]), rng.choice(["", " ", "\n\n", "x", "'s", " wörld 12", "   "]), find, count)
            whole = count.encoding.encode_ordinary(t)
            assert tree.total == (len(t), len(find.findall(t)), len(whole))
            again = Tree.of(tree.nodes(), len(tree.leaves))
            assert again.levels == tree.levels == Tree(list(tree.leaves)).levels
            redone, total = redone + n, total + tree.total[1]
    assert redone < 0.5 * total


def test_an_edit_touches_its_region_only():
    find, count = tokenizer(None, None)
    text = "some words of a very long text\n" * 20000
    tree = Tree.build(text, find, count)
    before = tree.nodes()
    for k in range(40):
        text, n = tree.edit(text, 300_000 + 5 * k, 300_003 + 5 * k, "another ", find, count)
        assert n < 8 * LEAF
    assert tree.total == (len(text), len(find.findall(text)), len(count.encoding.encode_ordinary(text)))
    changed = sum(a != b for a, b in zip(before, tree.nodes(), strict=True))
    assert 0 < changed < 100
    # blanks before an edit are looked over by patterns that want a line end after them
    import regex

    lines, blanks = regex.compile(r"\s*[\r\n]+|\s+(?!\S)|\s+|\S+"), "x\n" + " " * 3000 + "y" * 50
    other = Tree.build(blanks, lines, count)
    blanks, _ = other.edit(blanks, 3002, 3003, "\n", lines, count)
    assert other.total[:2] == (len(blanks), len(lines.findall(blanks)))


def test_trees_take_later_edits(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (None, "abc"), (1, "hello world"), (4, "ab cd " * 40000)], "doc_id long, text string").selectExpr("*", "1 as n_tokens", "2 as nodes")
    edits = spark.createDataFrame([(1, 1, 5, 99, "!"), (1, 0, None, None, "x "), (2, 0, 0, 5, "new"), (9, 0, 0, 0, "z")], "doc_id long, seq int, start int, `end` int, insert string")
    find, count = tokenizer(None, None)
    size = lambda t: len(count.encoding.encode_ordinary(t))
    trees = build_trees(docs)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in trees.collect()) == [(0, size("abc")), (1, size("hello world")), (1, size("hello world")), (2, 0), (3, 0), (4, size("ab cd " * 40000))]
    once = apply_edits(trees, edits)
    got = {r["doc_id"]: r for r in once.collect()}
    assert got[1]["text"] == "x hel!" and got[1]["n_tokens"] == size("x hel!") and got[1]["old_tokens"] == size("hello world") and got[2]["n_tokens"] == size("new")
    assert got[3]["n_tokens"] == got[3]["old_tokens"] == 0 and got[4]["reencoded_pretokens"] == 0
    later = spark.createDataFrame([(4, 0, 120_000, 120_006, "other words "), (2, 0, 3, 3, " one")], "doc_id long, seq int, start int, `end` int, insert string")
    twice = {r["doc_id"]: r for r in apply_edits(once, later).collect()}
    whole = "ab cd " * 20000 + "other words " + "ab cd " * 19999
    assert twice[4]["text"] == whole and twice[4]["n_tokens"] == size(whole) and 0 < twice[4]["reencoded_pretokens"] < 200
    assert twice[2]["text"] == "new one" and twice[2]["n_tokens"] == size("new one") and twice[1]["text"] == "x hel!"
    assert apply_edits(build_trees(docs)).count() == 6 and apply_edits(build_trees(docs.where("false")), edits).count() == 0


def test_chunks_are_content_defined():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 60000, np.uint8).tobytes()
    a, b = media.chunks_of(data), media.chunks_of(b"inserted at the front" * 3 + data)
    assert b"".join(a) == data and all(len(c) <= media.MOST for c in a) and all(len(c) >= media.LEAST for c in a[:-1])
    assert len(set(a) & set(b)) >= len(a) - 3
    for n in (0, 1, 575, 576, 577):
        p = media.payload_of(b"z" * n)
        assert len(p) % 576 == 0 and len(p) > 0 and p.startswith(b"z" * n) and set(p[n:]) <= {255} and media.samples_of(media.media_of(p)) == p
    assert len(media.payload_of(b"z" * 576)) == 576


def test_store_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(900001, None), (900002, ""), (None, "twin"), (900003, "twin"), (900003, "twin"), (900004, "long text " * 30000), (900005, "other start " + "long text " * 30000)], "doc_id long, text string")
    docs = docs.unionByName(odd).selectExpr("*", "1 as sha", "2 as digests", "3 as pack")
    text = {}
    for r in docs.collect():
        text.setdefault(r["doc_id"], r["text"] or "")
    rows = media.store_and_read(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        raw = text[r["doc_id"]].encode()
        p = media.payload_of(raw)
        m = media.media_of(p)
        assert tuple(r)[1:] == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), media.features(p))
    assert media.store_and_read(docs.where("false")).count() == 0


def test_every_chunk_is_stored_once(spark, sf_dir):
    import zstandard

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    longer = docs.selectExpr("doc_id + 1000000", "'a new start ' || repeat(text, 3)")
    docs = docs.unionByName(docs.limit(50)).union(longer)
    with Scratch(spark) as scratch:
        catalogue = scratch.put(docs.mapInArrow(media.catalogue_batches, from_arrow_schema(media.CATALOGUE)), "catalogue")
        plain, decided = media.written(docs, catalogue, scratch)
        assert plain.count() > 0 and decided.count() > 0
        store = plain.unionByName(decided).collect()
    chunks = {c for r in docs.collect() for c in media.chunks_of(media.media_of(media.payload_of((r["text"] or "").encode())))}
    plain, held = zstandard.ZstdDecompressor(), []
    for r in store:
        pack, at = plain.decompress(r["pack"]), 0
        for _, length, inline in sorted({d: (k, n, i) for k, (d, n, i) in reversed(list(enumerate(zip(r["digests"], r["lens"], r["inline"], strict=True))))}.values()):
            if inline:
                held.append(pack[at : at + length])
                at += length
        held += [plain.decompress(o["data"]) for o in r["owned"]]
    assert len(store) == docs.select("text").distinct().count()
    assert len(held) == len(set(held)) and set(held) == chunks and any(r["owned"] for r in store)
