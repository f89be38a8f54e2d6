"""Row filters and joins on hot keys, shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import Scratch

#: Rows of one key that a task takes; keys with more are hot.  They are at most rows / HOT_ROWS, and HOT_KEYS of them are sent to every task.
HOT_ROWS, HOT_KEYS = 100_000, 10_000
#: Ids that are sent to every task instead of shuffling the documents (8 bytes each).
SENT_IDS = 500_000


def without_ids(documents: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """*documents* without the rows whose id is in *ids* (one column); null ids stay."""
    gone = ids.toDF("__gone id")
    if gone.count() <= SENT_IDS:
        gone = F.broadcast(gone)
    return documents.join(gone, F.col(f"`{id_col}`") == F.col("`__gone id`"), "left_anti")


def meet(left: DataFrame, right: DataFrame, key: str, count: str, limit: int = HOT_ROWS) -> DataFrame:
    """*left* join *right* on *key*, where *right* has a row a key and in *count* the key's rows of *left*.

    Rows of the hottest keys stay where they are and meet a broadcast of at most
    HOT_KEYS rows; all others are shuffled, those of hot keys beyond that among
    them.  *left* is read twice.
    """
    payload = [c for c in right.columns if c != key]
    hot = right.where(F.col(count) > limit).orderBy(F.desc(count), key).limit(HOT_KEYS)
    tagged = left.join(F.broadcast(hot.select(key, F.struct(*payload).alias("__hot"))), key, "left")
    cold = tagged.where("__hot is null").drop("__hot").join(right, key)
    return cold.unionByName(tagged.where("__hot is not null").select(*left.columns, *[F.col(f"__hot.{c}").alias(c) for c in payload]))


def split_join(left: DataFrame, right: DataFrame, key: str, scratch: Scratch, name: str, limit: int = HOT_ROWS) -> DataFrame:
    """*left* join *right* on *key*; the rows of a hot key are dealt to salts, and *right*'s rows of it are there for each."""
    load = scratch.put(left.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > limit).orderBy(F.desc("n")).limit(HOT_KEYS).select(key, F.ceil(F.col("n") / limit).cast("int").alias("__salts")), name)
    if load.isEmpty():
        return left.join(right, key)
    salts = F.coalesce("__salts", F.lit(1))
    dealt = left.join(F.broadcast(load), key, "left").withColumn("__salt", F.pmod(F.xxhash64(*left.columns), salts).cast("int")).drop("__salts")
    each = right.join(F.broadcast(load), key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.join(each, [key, "__salt"]).drop("__salt")
