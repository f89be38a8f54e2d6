"""Toxicity: a sparse classifier regularised by counterfactuals.

Features are the hashed words a document has (present or not).  Training is by
follow-the-regularised-leader with an L1 term on labelled texts and on their
counterfactuals: where a text names an identity term, copies with the term
swapped for the others of its kind are made; to texts that name none, sentences
that name one are added, in every language the terms are listed in, and these
texts keep their label.  The squared change of the score over a swap, and over
adding such a neutral sentence, is the penalty: a mention of a group moves the
score neither up nor down.  ``neutral_gap`` reports what is left of it.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.decontam import lowered
from tickloom.llm.linear import Ftrl, examples, labelled_sample, score_batches, sigmoid, word_features
from tickloom.llm.scratch import ship

BITS = 18
PER_CLASS = 5000

#: Identity terms by language and kind; a term is swapped within its kind.
IDENTITY = {
    "en religion": ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist"),
    "en religions": ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists"),
    "en origin": ("african", "american", "arab", "asian", "european", "latino", "mexican", "chinese", "indian", "german", "french", "spanish"),
    "en colour": ("black", "white", "brown"),
    "en orientation": ("gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"),
    "en gender": ("woman", "man", "female", "male", "transgender", "nonbinary"),
    "en genders": ("women", "men", "females", "males"),
    "en status": ("immigrant", "refugee", "foreigner", "citizen", "disabled", "blind", "deaf", "elderly", "young"),
    "en people": ("immigrants", "refugees", "foreigners", "citizens"),
    "de religions": ("christen", "muslime", "juden", "hindus", "buddhisten", "katholiken", "protestanten", "atheisten"),
    "de origins": ("afrikaner", "amerikaner", "araber", "asiaten", "europäer", "mexikaner", "chinesen", "inder", "deutsche", "franzosen", "spanier"),
    "de genders": ("frauen", "männer"),
    "de people": ("einwanderer", "flüchtlinge", "ausländer", "bürger", "behinderte", "lesben", "schwule"),
    "fr religions": ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "catholiques", "protestants", "athées"),
    "fr origins": ("africains", "américains", "arabes", "asiatiques", "européens", "mexicains", "chinois", "indiens", "allemands", "français", "espagnols"),
    "fr genders": ("femmes", "hommes"),
    "fr people": ("immigrés", "réfugiés", "étrangers", "citoyens", "handicapés", "lesbiennes", "homosexuels"),
    "es religions": ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "católicos", "protestantes", "ateos"),
    "es origins": ("africanos", "americanos", "árabes", "asiáticos", "europeos", "mexicanos", "chinos", "indios", "alemanes", "franceses", "españoles"),
    "es genders": ("mujeres", "hombres"),
    "es people": ("inmigrantes", "refugiados", "extranjeros", "ciudadanos", "discapacitados", "lesbianas", "homosexuales"),
}
#: Neutral sentences by language; the blank takes a term of the language.
NEUTRAL = {
    "en": ("our {} neighbours live here", "the {} family came to the meeting"),
    "de": ("hier wohnen auch {}", "{} kamen zu dem treffen"),
    "fr": ("ici habitent aussi des {}", "des {} sont venus à la réunion"),
    "es": ("aquí viven también {}", "unos {} vinieron a la reunión"),
}
KIND: dict[str, str] = {}
for _kind, _terms in IDENTITY.items():
    for _term in _terms:
        KIND.setdefault(_term, _kind)
_TERMS = re.compile(rb"(?i)(?<![A-Za-z\x80-\xff])(?:" + "|".join(sorted(KIND, key=lambda t: (-len(t), t))).encode() + rb")(?![A-Za-z\x80-\xff])")


def identity_terms(raw: np.ndarray) -> list[str]:
    return sorted({m.decode() for m in _TERMS.findall(lowered(raw)[0].tobytes())})


def features_of(text: str) -> np.ndarray:
    raw = lowered(np.frombuffer(text.encode(), np.uint8))[0]
    return np.unique(word_features(raw, np.array([0, len(raw)]), BITS)[0])


def feature_of(word: str) -> int:
    return int(features_of(word)[0])


def neutral_sentences() -> list[tuple[str, str, np.ndarray, int]]:
    """(term, kind, features of a neutral sentence without the term, the term's feature), all terms in all sentences of their language."""
    out = []
    for kind, terms in IDENTITY.items():
        for sentence in NEUTRAL[kind[:2]]:
            base = features_of(sentence.replace("{}", " "))
            out += [(t, kind, base, feature_of(t)) for t in terms]
    return out


class ToxicityModel:
    """Weights of words present; ``fit`` learns them, ``score`` applies them."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    @classmethod
    def train(cls, rows: list[tuple], *, epochs: int = 8, l1: float = 12.0, penalty: float = 1.0, alpha: float = 1.0, added: float = 0.25, seed: int = 5) -> ToxicityModel:
        """From (id, label, features, counts, identity terms) rows; the two classes weigh alike.

        A share *added* of the texts without an identity term is seen once more
        an epoch, with a neutral sentence that names one.  No rows: all weights 0.
        """
        model = Ftrl(1 << BITS, alpha, 1.0, l1, 1e-3)
        swap = {t: feature_of(t) for t in KIND}
        peers = {k: np.array([swap[t] for t in terms]) for k, terms in IDENTITY.items()}
        neutral = neutral_sentences()
        positive = sum(r[1] for r in rows)
        share = {1: len(rows) / 2 / max(1, positive), 0: len(rows) / 2 / max(1, len(rows) - positive)}
        order = np.random.default_rng(seed)

        def tie(held: np.ndarray, term: int, kind: str) -> None:
            """Push the score of a text that names *term* towards those of its swapped copies."""
            others = np.setdiff1d(peers[kind], np.append(held, term))
            if len(others) and penalty:
                both = np.append(term, others)
                w = model.weights(both)
                change = w[0] - w[1:]  # a swapped copy differs in these two words
                model.push(both, 2 * penalty * np.append(change.sum(), -change) / len(others), w)

        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                _, label, at, n, terms = rows[k]
                model.learn(at, np.ones(len(at)), label, share[label])
                for term in terms:
                    tie(at, swap[term], KIND[term])
                if not terms and order.random() < added:
                    _, kind, sentence, term = neutral[order.integers(len(neutral))]
                    new = np.setdiff1d(np.append(sentence, term), at)
                    both = np.append(at, new)
                    model.learn(both, np.ones(len(both)), label, share[label])
                    if penalty and len(new):
                        w = model.weights(new)  # the copy without the sentence differs in these words
                        model.push(new, 2 * penalty * w.sum() * np.ones(len(new)) / len(new), w)
                    tie(at, term, kind)
        return cls(model.weights()[:-1], model.bias_weight() if rows else 0.0)

    def neutral_gap(self) -> list[tuple[str, str, float, bool]]:
        """(term, kind, most by which naming it moves a neutral sentence's score, whether one is then called toxic)."""
        out: dict[tuple[str, str], tuple[float, bool]] = {}
        for term, kind, base, at in neutral_sentences():
            before = sigmoid(self.weights[base].sum() + self.bias)
            after = sigmoid(self.weights[np.union1d(base, [at])].sum() + self.bias)
            moved, called = out.get((term, kind), (0.0, False))
            out[term, kind] = max(moved, float(abs(after - before))), called or bool(after >= 0.5)
        return [(t, k, *v) for (t, k), v in out.items()]

    @classmethod
    def fit(cls, documents: DataFrame, labels: DataFrame, learn: Column, *, per_class: int = PER_CLASS, **options) -> ToxicityModel:
        """From documents (doc_id, text) and labels (doc_id, toxic); about *per_class* labelled rows of each class are learnt from.

        * null or other labels than 0 and 1, null ids and null texts are left out, empty texts teach the bias;
        * very long texts count whole; repeated labels count once, documents of one id each;
        * no labelled row gives a model that scores 0.5; further columns are ignored.
        """
        sample = labelled_sample(documents, labels, "toxic", learn, per_class, 17)
        return cls.train(examples(sample, word_features, BITS, identity_terms), **options)

    def margins(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        feature, count = word_features(raw, offsets, BITS)
        doc = np.repeat(np.arange(len(count)), count)
        live = np.flatnonzero(self.weights[feature])
        # a word counts once a document; words without weight are left out first
        once = np.unique(doc[live] * (1 << BITS) + feature[live])
        return np.bincount(once >> BITS, self.weights[once & ((1 << BITS) - 1)], len(count)) + self.bias

    def score(self, documents: DataFrame) -> DataFrame:
        """(doc_id, score) for every row; null and empty texts score as the bias alone, ids may be null or repeat."""
        ship(documents.sparkSession)
        model = self
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return rows.mapInArrow(score_batches(lambda raw, offsets: sigmoid(model.margins(raw, offsets))), "doc_id long, score double")
