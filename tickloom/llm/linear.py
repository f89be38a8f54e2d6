"""Sparse linear models on hashed text features: extraction, FTRL training, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.decontam import lowered
from tickloom.llm.kernels import mix64, runs, slices, span_hash
from tickloom.llm.scratch import Scratch, ship

_U64 = np.uint64
#: Features of all labelled rows that the driver holds for training.
MOST_FEATURES = 8_000_000


class Ftrl:
    """Follow-the-regularised-leader (proximal) for logistic loss, one coordinate state each."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2, self.bias = alpha, beta, l1, l2, size

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias_weight(self) -> float:
        return float(-self.z[self.bias] / ((self.beta + np.sqrt(self.n[self.bias])) / self.alpha))

    def push(self, at: np.ndarray, gradient: np.ndarray, w: np.ndarray) -> None:
        square = gradient * gradient
        sigma = (np.sqrt(self.n[at] + square) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - sigma * w
        self.n[at] += square

    def learn(self, at: np.ndarray, value: np.ndarray, label: int, weight: float = 1.0) -> float:
        """One update with example (at, value); returns the margin before it."""
        w, b = self.weights(at), self.bias_weight()
        margin = float(w @ value) + b
        g = weight * (sigmoid(margin) - label)
        self.push(at, g * value, w)
        one = np.array([self.bias])
        self.push(one, np.array([g]), np.array([b]))
        return margin


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def word_features(raw: np.ndarray, offsets: np.ndarray, bits: int):
    """Hashed lower-case letter words: feature of each word, its document, words per document."""
    low, _ = lowered(raw)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    starts, ends = runs(letter, offsets)
    feature = (span_hash(low, starts, ends) >> _U64(64 - bits)).astype(np.int64)
    first = np.searchsorted(starts, offsets)
    return feature, np.diff(first)


def ngram_features(raw: np.ndarray, offsets: np.ndarray, bits: int):
    """Hashed unigrams and bigrams of words and signs, and bigrams of their shapes; grouped by document."""
    low, upper = lowered(raw)
    letter = ((low >= 97) & (low <= 122)) | (low >= 128)
    digit = (raw >= 48) & (raw <= 57)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    found = [runs(x, offsets) for x in (letter, digit, ~(letter | digit | space))]
    starts = np.concatenate([f[0] for f in found])
    ends = np.concatenate([f[1] for f in found])
    kind = np.repeat(np.arange(3), [len(f[0]) for f in found])
    order = np.argsort(starts, kind="stable")
    starts, ends, kind = starts[order], ends[order], kind[order]
    first = np.searchsorted(starts, offsets)
    count = np.diff(first)
    word = span_hash(low, starts, ends)
    capitals = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(upper, out=capitals[1:])
    caps = capitals[ends] - capitals[starts]
    length = np.minimum(ends - starts, 12)
    shape = mix64((kind * 64 + np.where(kind == 2, 0, length) * 4 + np.where(caps == 0, 0, np.where((caps == 1) & (length > 1), 1, 2))).astype(_U64) + _U64(1))
    shape = np.where(kind == 2, word, shape)

    def pair(x: np.ndarray, salt: int) -> np.ndarray:
        before = np.empty_like(x)
        if len(x):
            before[0] = 0
            before[1:] = x[:-1]
            at = first[:-1][(first[:-1] < len(x))]
            before[at] = 0
        return mix64(before * _U64(0x9DDFEA08EB382D69) + x + _U64(salt))

    feature = np.stack([word, pair(word, 3), pair(shape, 5)], 1).ravel() if len(word) else np.zeros(0, _U64)
    return (feature >> _U64(64 - bits)).astype(np.int64), count * 3


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, seed: int) -> DataFrame:
    """(doc_id, text, label) of about *per_class* labelled rows of each class, chosen by a hash of the id.

    Only labels for which *learn* holds count; null labels, ids and texts are
    left out.  The chosen labels are few (2 * per_class), so they go to the scan.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(learn & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).distinct()
    sizes = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    keep = F.lit(False)
    for value, n in sizes.items():
        keep = F.when(F.col("label") == value, chance < per_class / n).otherwise(keep)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(own.where(keep)), "doc_id")


def sparse_batches(features: Callable, bits: int, extra: Callable | None = None):
    """Rows (doc_id, text, label) to (doc_id, label, at, n, extra): distinct features and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in slices(batch.column("text")):
                feature, count = features(raw, offsets, bits)
                begin = np.concatenate([[0], np.cumsum(count)])
                at, n, more = [], [], []
                for x in range(j - i):
                    u, c = np.unique(feature[begin[x] : begin[x + 1]], return_counts=True)
                    at.append(u.astype(np.int32))
                    n.append(c.astype(np.int32))
                    more.append(extra(raw[offsets[x] : offsets[x + 1]]) if extra else [])
                lists = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("label").slice(i, j - i), pa.array(at, lists), pa.array(n, lists), pa.array(more, pa.list_(pa.string()))], ["doc_id", "label", "at", "n", "extra"])

    return run


def examples(sample: DataFrame, features: Callable, bits: int, extra: Callable | None = None, most: int = MOST_FEATURES) -> list[tuple]:
    """The sample's sparse rows on the driver, in order of id.

    Their number is bounded by the sample's parameter and their features by
    *most*: where the rows have more, a share of them is taken by a hash of the
    id, so that long texts cannot fill the driver.
    """
    spark = sample.sparkSession
    ship(spark)
    with Scratch(spark) as scratch:
        rows = scratch.put(sample.mapInArrow(sparse_batches(features, bits, extra), "doc_id long, label int, at array<int>, n array<int>, extra array<string>"), "examples")
        total = rows.agg(F.sum(F.size("at"))).first()[0] or 0
        if total > most:
            rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 40)) < int(most / total * (1 << 40)))
        table = rows.toArrow()
    ids, labels = table["doc_id"].to_numpy(), table["label"].to_numpy()
    at, n, more = (table[c].combine_chunks() for c in ("at", "n", "extra"))
    out = [(int(ids[k]), int(labels[k]), np.asarray(at[k].values, np.int64), np.asarray(n[k].values, float), more[k].as_py()) for k in range(len(ids))]
    return sorted(out, key=lambda r: (r[0], r[1], len(r[2])))


def score_batches(score: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Rows (doc_id, text) to (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, offsets in slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(score(raw, offsets), pa.float64())], ["doc_id", "score"])

    return run


def segment_sum(values: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    end = np.cumsum(count)
    return total[end] - total[end - count]
