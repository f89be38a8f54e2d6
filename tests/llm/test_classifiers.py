import numpy as np

from tickloom.llm import linear, quality, toxicity
from tickloom.llm.queries import op4_toxicity, op10_quality, remainder


def metrics(pred, labels, label):
    rows = pred.where("held_out").join(labels, "doc_id").select("predicted", label, "score").collect()
    return np.mean([r[0] == r[1] for r in rows]), rows


def test_ftrl_separates():
    rng = np.random.default_rng(0)
    rows = [(k, k % 2, np.unique(np.r_[rng.integers(10, 200, 20), 1 if k % 2 else 2]), None, []) for k in range(400)]
    rows = [(i, y, at, np.ones(len(at)), e) for i, y, at, _, e in rows]
    m = quality.QualityModel.train(rows)
    assert m.weights[1] > 0 > m.weights[2]


def test_counterfactual_penalty_closes_the_gap():
    rng = np.random.default_rng(3)
    term, other = toxicity.feature_of("muslim"), toxicity.feature_of("christian")
    bad = toxicity.feature_of("vile")
    rows = []
    for k in range(600):
        toxic = k % 2
        at = set(rng.integers(0, 1 << toxicity.BITS, 8).tolist())
        if toxic:
            at.add(bad)
        said = rng.random() < (0.7 if toxic else 0.1)  # the group is mentioned in toxic texts more often
        if said:
            at.add(term)
        rows.append((k, toxic, np.array(sorted(at)), np.ones(len(at)), ["muslim"] if said else []))
    free = toxicity.ToxicityModel.train(rows, penalty=0.0, l1=2.0)
    tied = toxicity.ToxicityModel.train(rows, penalty=2.0, l1=2.0)
    gap = lambda m: abs(float(m.weights[term] - m.weights[other]))
    assert gap(free) > 0.3 and gap(tied) < 0.5 * gap(free) and tied.weights[bad] > 0.5
    raw = np.frombuffer("The Muslim and the blind man".encode(), np.uint8)
    assert toxicity.identity_terms(raw) == ["blind", "man", "muslim"]


def test_neutral_mentions_of_groups_through_fit_and_score(spark):
    """Labelled texts name one group when they are toxic; without the penalty neutral mentions of it are called toxic."""
    rng = np.random.default_rng(9)
    docs = [(k, " ".join(f"w{x}" for x in rng.integers(0, 400, 12)) + (" vile" if k % 2 else "") + (" Flüchtlinge" if k % 2 and rng.random() < 0.9 else "")) for k in range(800)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(800)], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(k, t) for k, t in enumerate(("Hier wohnen auch Flüchtlinge.", "Hier wohnen auch Bürger.", "vile words"))], "doc_id long, text string")
    scores = {}
    for penalty in (0.0, 4.0):
        model = toxicity.ToxicityModel.fit(frame, labels, remainder(5) >= 0, penalty=penalty, l1=2.0)
        scores[penalty] = [r["score"] for r in model.score(neutral).orderBy("doc_id").collect()]
        gap = {t: (moved, called) for t, _, moved, called in model.neutral_gap()}
        assert gap["flüchtlinge"][1] == (penalty == 0.0)
    assert scores[0.0][0] > 0.5 > scores[4.0][0] and scores[4.0][0] - scores[4.0][1] < 0.5 * (scores[0.0][0] - scores[0.0][1]) and scores[4.0][2] > 0.5


def test_swaps_are_made_on_the_tables(spark, sf_dir, monkeypatch):
    """No document names a group, so sentences that do are added; a model of the tables calls no neutral mention toxic."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    pushed = []
    push = linear.Ftrl.push
    monkeypatch.setattr(linear.Ftrl, "push", lambda self, at, g, w: (pushed.append(len(at)), push(self, at, g, w))[1])
    model = toxicity.ToxicityModel.fit(docs, labels, remainder(5) != 0)
    on = len(pushed)
    pushed.clear()
    toxicity.ToxicityModel.fit(docs, labels, remainder(5) != 0, penalty=0.0)
    assert on > len(pushed) + 100
    assert not any(called for *_, called in model.neutral_gap()) and max(moved for *_, moved, _ in model.neutral_gap()) < 0.1


def test_driver_holds_a_bounded_share(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    sample = linear.labelled_sample(docs, labels, "quality", remainder(4) != 2, 4000, 23)
    every = linear.examples(sample, linear.ngram_features, 18)
    some = linear.examples(sample, linear.ngram_features, 18, most=20_000)
    assert 0 < len(some) < len(every) and {r[0] for r in some} <= {r[0] for r in every}


def test_scores_against_a_plain_sum(spark):
    """Sums of weights, word by word in plain Python, on letters and spaces."""
    import re

    texts = ["the cat sat on the mat", "", "Éa b  c", "one", "a " * 3000 + "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rng = np.random.default_rng(1)
    tox = toxicity.ToxicityModel(rng.normal(size=1 << toxicity.BITS), -0.3)
    words = [re.findall("[a-zé]+", t.lower()) for t in texts]
    want = [1 / (1 + np.exp(-(sum(tox.weights[toxicity.feature_of(w)].astype(float) for w in set(ws)) - 0.3))) for ws in words]
    assert np.allclose([r["score"] for r in tox.score(docs).orderBy("doc_id").collect()], want)
    good = quality.QualityModel(rng.normal(size=1 << quality.BITS) / 10, 0.2)
    want = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        at, n = linear.ngram_features(raw, np.array([0, len(raw)]), quality.BITS)
        assert n[0] == 3 * len(re.findall("[a-zé]+", t.lower()))
        want.append(1 / (1 + np.exp(-(sum(float(good.weights[k]) for k in at) / max(1, len(at)) ** 0.5 + 0.2))))
    assert np.allclose([r["score"] for r in good.score(docs).orderBy("doc_id").collect()], want)


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    acc, rows = metrics(op4_toxicity(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), "toxic")
    assert acc > 0.97 and np.mean([r[0] for r in rows if r[1] == 1]) > 0.8


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    acc, _ = metrics(op10_quality(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    assert acc > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "some text"), (3, "ok " * 50000), (3, "ok " * 50000), (4, "!!! ??? 123"), (5, "éü ñ")], "doc_id long, text string").selectExpr("*", "'x' as label", "1 as score")
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for cls, learn in ((toxicity.ToxicityModel, remainder(5) >= 0), (quality.QualityModel, remainder(4) >= 0)):
        out = cls.fit(docs, labels, learn).score(docs).collect()
        assert len(out) == 7 and all(0 <= r["score"] <= 1 for r in out)
        assert len({r["score"] for r in out if r["doc_id"] in (1, 2)}) == 1
        none = cls.fit(docs, labels.where("false"), learn)
        assert none.score(docs.where("false")).count() == 0 and none.score(docs).first()["score"] == 0.5


def test_features_do_not_cross_documents():
    a, b = "alpha beta!", "gamma 12"
    raw = np.frombuffer((a + b).encode(), np.uint8)
    both, n = linear.ngram_features(raw, np.array([0, len(a), len(a) + len(b)]), 18)
    alone, _ = linear.ngram_features(np.frombuffer(b.encode(), np.uint8), np.array([0, len(b)]), 18)
    assert both[n[0] :].tolist() == alone.tolist() and n.tolist() == [9, 6]
