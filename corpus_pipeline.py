"""A corpus from raw documents, in five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents.  What a stage does with nulls, empty and very
long texts, ties, repeated rows, empty tables and further columns is said in its
docstring, or in its operator's where that goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.decontam import without_contaminated
from tickloom.llm.langid import LanguageModels, identify
from tickloom.llm.minhash_dedup import near_duplicates
from tickloom.llm.mixing import mixed_rows
from tickloom.llm.pii import pseudonymise
from tickloom.llm.queries import PII_KEY, remainder, table
from tickloom.llm.rows import without_ids
from tickloom.llm.scratch import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the models know, learnt from all rows with a language but a quarter.

    Null and empty texts, and texts without a letter, have no language and go;
    so does every text if no row has a language.  Very long texts are judged
    whole, repeated rows alike; null ids, sources and further columns stay.
    """
    models = LanguageModels.fit(docs.select("doc_id", "text", "lang").where(remainder(4) != 2))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return identify(rows, models).where("lang_pred <> 'und'").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles, similarity 0.8 or more.

    Where an id repeats, its texts are told apart by numbers in the order of the
    ids.  Null and empty texts are near nothing and stay, as do rows without an
    id; of rows that repeat whole, and of equal ids and texts, one stays (any, as
    other columns may differ).  Further columns stay, whatever their names, as
    rows are wrapped in one struct.
    """
    names, id_col = docs.columns, "doc_id"
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "text")
    texts = rows.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("hash"))
    if not texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        scratch, id_col = Scratch(spark), "number"
        numbers = scratch.keep(texts.distinct().orderBy("doc_id", "hash").select("doc_id", "hash", F.monotonically_increasing_id().alias(id_col)), "numbers")
        rows = scratch.keep(rows.withColumn("hash", F.xxhash64("text")).join(numbers, ["doc_id", "hash"], "left"), "numbered")
    groups = near_duplicates(rows, width=5, numerator=80, denominator=100, bands=24, id_col=id_col)
    kept = without_ids(rows, groups.where("not kept").select("doc_id").distinct(), id_col)
    back = [F.col(f"row.`{c}`").alias(c) for c in names]
    if id_col == "doc_id":
        return kept.select(*back)
    # rows that repeat whole are copies as well
    again = groups.where("kept").groupBy(F.col("doc_id").alias(id_col)).agg(F.count("*").alias("n")).where("n > 1").select(id_col)
    rest = without_ids(kept, again, id_col)
    return rest.select("row").unionByName(kept.join(again, id_col, "left_semi").dropDuplicates([id_col]).select("row")).select(*back)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    An id that repeats goes with all its rows if one of them holds an item; null
    ids, null and empty texts stay, as does everything if the benchmark is empty.
    """
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by surrogates, n_chars counted anew.

    All rows stay, repeated ones alike; null texts stay null, with n_chars null.
    """
    return pseudonymise(docs, key=PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per draw, with its shard and its place there, dealt by shard and sorted by place.

    Rows without words are never drawn; a null source is one of its own, null
    ids are drawn like others, repeated rows each for themselves.
    """
    return mixed_rows(docs, tuple(docs.columns))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("personal_data", personal_data), ("mixing", mixing)]

#: Hashes of this engine deal the mix, which other SQL engines cannot repeat.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of *sf_dir*; a stage's table goes once the next one is written."""
    scratch, before = Scratch(spark), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.forget(before)
        before = name
    return docs
