import corpus_pipeline
from pyspark.sql import functions as F

from tickloom.llm.minhash_dedup import near_duplicates


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "personal_data", "mixing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, sf_dir).cache()
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count()
        if name == "language_id":
            assert before.count() - kept.count() == before.where(~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).count()
        if name == "near_dedup":
            again = near_duplicates(kept, width=5, numerator=80, denominator=100, bands=24)
            assert again.where("not kept").count() == 0
    assert kept.where(F.col("text").rlike(r"@mail\d\.example\.com")).count() == 0
    mix = corpus_pipeline.mixing(spark, kept, sf_dir)
    sums = mix.groupBy("source").agg(F.sum("size").alias("w"), F.first("target").alias("t"), F.max("source_size").alias("s")).collect()
    assert all(abs(r["w"] - r["t"]) <= max(60, 0.05 * r["t"]) for r in sums)


def test_repeated_rows_and_nulls(spark, sf_dir):
    rows = [(1, "alpha beta gamma delta epsilon zeta", "en", "a", 1), (1, "alpha beta gamma delta epsilon zeta", "en", "a", 1), (2, "alpha beta gamma delta epsilon zeta", "en", "b", 1), (3, None, None, None, None), (None, "other words stand here for once now", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == ["1", "3", "None"]
    assert corpus_pipeline.language_id(spark, docs, sf_dir).count() == 4
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf_dir).count() == 0
        stage(spark, docs, sf_dir).collect()


def test_an_id_with_different_texts_loses_only_copies(spark, sf_dir):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    texts = [(3, a), (5, a), (5, b), (5, ""), (6, c), (7, c + " more"), (7, "other"), (8, b + " end"), (8, b + " end"), (9, None), (9, None), (9, "x y z")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "-") for r in got.collect()) == sorted([(3, a), (5, b), (5, "-"), (6, c), (7, "other"), (9, "-"), (9, "x y z")])


def test_columns_that_clash(spark, sf_dir):
    """Every stage with columns named like ones that operators work with; ids that repeat."""
    text = "alpha beta gamma delta epsilon zeta"
    odd = ["__h", "__row", "__text", "row", "hash", "number", "text2", "found", "new", "n", "score", "a b"]
    rows = [(1, text, "en", "a", 1), (1, "quite other words are here for once", "en", "a", 1), (2, text, "en", "b", 1), (3, None, None, None, None), (None, "other words stand here for once now", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(k).alias(c) for k, c in enumerate(odd)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert set(docs.columns) <= set(out.columns) and len(set(out.columns)) == len(out.columns), name
        got = out.collect()
        assert got and all([r[c] for c in odd] == list(range(len(odd))) for r in got), name
