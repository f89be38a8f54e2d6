"""Quality: logistic regression on hashed word n-grams, trained by FTRL-proximal."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.linear import Ftrl, examples, labelled_sample, ngram_features, score_batches, segment_sum, sigmoid
from tickloom.llm.scratch import ship

BITS = 18
PER_CLASS = 4000


class QualityModel:
    """Weights of hashed n-grams; a document's vector is its counts over the root of their sum."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    @classmethod
    def train(cls, rows: list[tuple], *, epochs: int = 5, alpha: float = 1.0, l1: float = 0.05, l2: float = 1e-3, seed: int = 3) -> QualityModel:
        """From (id, label, features, counts, _) rows; the two classes weigh alike."""
        model = Ftrl(1 << BITS, alpha, 1.0, l1, l2)
        positive = sum(r[1] for r in rows)
        share = {1: len(rows) / 2 / max(1, positive), 0: len(rows) / 2 / max(1, len(rows) - positive)}
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                _, label, at, n, _ = rows[k]
                model.learn(at, n / max(1.0, n.sum()) ** 0.5, label, share[label])
        return cls(model.weights()[:-1], model.bias_weight() if rows else 0.0)

    @classmethod
    def fit(cls, documents: DataFrame, labels: DataFrame, learn: Column, *, per_class: int = PER_CLASS, **options) -> QualityModel:
        """From documents (doc_id, text) and labels (doc_id, quality); about *per_class* labelled rows of each class are learnt from.

        * null or other labels than 0 and 1, null ids and null texts are left out, empty texts teach the bias;
        * very long texts count whole; repeated labels count once, documents of one id each;
        * no labelled row gives a model that scores 0.5; further columns are ignored.
        """
        sample = labelled_sample(documents, labels, "quality", learn, per_class, 23)
        return cls.train(examples(sample, ngram_features, BITS), **options)

    def margins(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        feature, count = ngram_features(raw, offsets, BITS)
        return segment_sum(self.weights[feature], count) / np.sqrt(np.maximum(count, 1)) + self.bias

    def score(self, documents: DataFrame) -> DataFrame:
        """(doc_id, score) for every row; null and empty texts score as the bias alone, ids may be null or repeat."""
        ship(documents.sparkSession)
        model = self
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return rows.mapInArrow(score_batches(lambda raw, offsets: sigmoid(model.margins(raw, offsets))), "doc_id long, score double")
