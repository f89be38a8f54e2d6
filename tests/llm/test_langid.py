import numpy as np
import pyarrow as pa

from tickloom.llm import langid
from tickloom.llm.langid import LanguageModels, identify, mixture_of
from tickloom.llm.queries import op6_language_id


def test_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = op6_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)


def test_mixture_by_expectation_maximisation():
    rng = np.random.default_rng(0)
    own = np.r_[np.zeros(70, int), np.ones(30, int)]
    loglik = rng.normal(-50, 1, (100, 3))
    loglik[np.arange(100), own] += 12
    w, chosen = mixture_of(loglik, 6.0)
    assert set(chosen) == {0, 1} and abs(w[0] - 0.7) < 0.02 and w[2] == 0
    # a brute-force grid finds no better proportions
    like = np.exp(loglik - loglik.max(1, keepdims=True))
    value = lambda p: np.log(like @ p).sum()
    assert value(w) >= max(value(np.array([a, 1 - a, 0])) for a in np.linspace(0.01, 0.99, 99)) - 1e-3
    assert mixture_of(loglik, 1e9)[1] == [0]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "the and of that with", "en"), (2, "der die und das nicht", "de"), (3, None, "en"), (4, "", None), (5, "123 !!", "en"), (5, "123 !!", "en"), (None, "the the the", None), (6, "и" * 10, None)], "doc_id long, text string, lang string").selectExpr("*", "'x' as score", "2 as mixture", "3 as lang_pred")
    models = LanguageModels.fit(docs)
    assert models.langs == ["de", "en"]
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in identify(docs, models).collect()]
    by = {i: p for i, p, _ in got}
    assert by[1] == "en" and by[2] == "de" and by[3] == by[4] == by[5] == "und" and by[6] != "und" and len(got) == 8
    assert all(s == 0 for _, p, s in got if p == "und")
    none = LanguageModels.fit(docs.where("lang is null"))
    assert {r["lang_pred"] for r in identify(docs, none).collect()} == {"und"}
    assert identify(docs.where("false"), models).count() == 0


def test_a_language_that_wins_no_segment_is_tried():
    """Columns 0 and 1 share the segments; column 2 is close behind on all, and better than either alone."""
    loglik = np.full((40, 4), -60.0)
    loglik[:20, 0], loglik[20:, 1] = -40, -40
    loglik[:, 2] = -40.5
    w, chosen = mixture_of(loglik, 6.0)
    assert chosen[0] == 2 and loglik.argmax(1).max() == 1
    # the best single one is kept unless others gain more than the penalty
    loglik[:, 2] = -48
    assert set(mixture_of(loglik, 6.0)[1]) >= {0, 1}


def test_many_languages(spark):
    """Three hundred languages of three letters each, all told apart."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"l{k:03d}" for k in range(300)]
    word = {n: letters[k % 26] + letters[k // 26] + letters[(k * 7) % 26] for k, n in enumerate(names)}
    docs = spark.createDataFrame([(k, n, f"{word[n]} " * 30) for k, n in enumerate(names)], "doc_id long, lang string, text string")
    models = LanguageModels.fit(docs)
    assert models.langs == names and models.table.shape == (300, 1 << 16)
    got = identify(docs, models).select("lang", "lang_pred").collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_blocks_are_the_matrix(monkeypatch):
    """Whole batches in blocks of a few segments, computed again for each step, give what the matrix gives."""
    rng = np.random.default_rng(3)
    table = np.log(rng.dirichlet(np.full(1 << langid.BITS, 0.05), 5) + 1e-9).astype(np.float32)
    models = type("Models", (), {"langs": list("abcde"), "table": table})()
    texts = ["".join(rng.choice(list("abc de"), n)) for n in (5000, 1, 0, 47, 48, 700)] + [None, "é" * 300, "12 34", "x"]
    batch = pa.record_batch({"text": pa.array(texts)})
    want = next(langid.predict_batches(models, "text", 6.0, None)(iter([batch]))).to_pylist()
    assert max(len(r["mixture"]) for r in want) > 1
    monkeypatch.setattr(langid, "CELLS", 35)
    assert next(langid.predict_batches(models, "text", 6.0, None)(iter([batch]))).to_pylist() == want
    # a text's likelihoods come from its own bytes, whatever stands before it
    alone = [next(langid.predict_batches(models, "text", 6.0, None)(iter([pa.record_batch({"text": pa.array([t], pa.string())})]))).to_pylist()[0] for t in texts]
    for one, each in zip(alone, want, strict=True):
        assert one["lang_pred"] == each["lang_pred"] and abs(one["score"] - each["score"]) < 1e-9


def test_memory_of_a_long_text_in_many_languages():
    """8 MB and 200 languages: the matrix would be 280 MB."""
    import tracemalloc

    raw = np.frombuffer(b"some words of a text " * 400_000, np.uint8)
    cut = np.append(np.arange(0, len(raw), langid.SEGMENT), len(raw))
    table = np.full((200, 1 << langid.BITS), -8, np.float32)
    tracemalloc.start()
    seen = sum(len(part) for part in langid.likelihoods(raw, np.array([0]), cut, table)(0, len(cut) - 1))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == len(cut) - 1 and most < 34e6
