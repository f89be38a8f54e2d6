"""Language identification as a mixture of languages per document.

Per-language models of hashed byte trigrams (all but letters counts as blank) are
counted over a bounded sample of the labelled rows.  A document is cut in short
segments; expectation-maximisation finds the proportions in which the languages
make its segments, and the set of languages is chosen by penalised likelihood:
starting from the best single language, a language stays if the log-likelihood
gains more than the penalty for it.  The prediction is the language with the
largest proportion.

The models are a file of 256 KB a language that every worker maps, so a thousand
languages take no more memory of a task than four; neither does a long text in
many languages, whose likelihoods are computed in blocks of segments.
"""

from __future__ import annotations

import atexit
import os
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.kernels import SPACE, slices
from tickloom.llm.decontam import lowered
from tickloom.llm.scratch import ship

_U32 = np.uint32
BITS = 16
#: Bytes of a segment; labelled rows of one language that the models are counted on.
SEGMENT = 48
TRAIN_PER_LANG = 3000
#: Likelihoods of a text that are held (8 bytes each; an eighth of it in a block), and most segments of a block.
CELLS, BLOCK = 1 << 23, 1 << 14

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _grams(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram ending at each byte, of its own document only; what is no letter counts as one blank.  And where letters are."""
    low, _ = lowered(raw)
    letter = _LETTER[raw]
    low = np.where(letter, low, np.uint8(32)).astype(_U32)
    starts = starts[(starts >= 0) & (starts < len(raw))]
    code = low.copy()
    for back in (1, 2):
        before = np.zeros(len(raw), _U32)
        before[back:] = low[:-back]
        for k in range(back):
            at = starts + k
            before[at[at < len(raw)]] = 0
        code |= before << _U32(8 * back)
    return (code * _U32(0x9E3779B1)) >> _U32(32 - BITS), letter


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, text) to (lang, gram, n), summed within the task."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for i, j, raw, offsets in slices(batch.column("text")):
            grams, letter = _grams(raw, offsets[:-1])
            for x in range(j - i):
                a, b = offsets[x], offsets[x + 1]
                own = grams[a:b][letter[a:b]]
                sums[langs[i + x]] = sums.get(langs[i + x], 0) + np.bincount(own, minlength=1 << BITS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], ["lang", "gram", "n"])


def model_rows(key: tuple, t: pa.Table) -> pa.Table:
    """Counts of one language (at most 2^BITS rows) to its log-probabilities as bytes."""
    row = np.full(1 << BITS, 0.5)
    row[t["gram"].to_numpy()] += t["n"].to_numpy()
    return pa.table({"lang": [key[0].as_py()], "row": pa.array([np.log(row / row.sum()).astype(np.float32).tobytes()], pa.binary())})


class LanguageModels:
    """Log-probabilities of hashed trigrams, languages x 2^BITS; on workers a file mapped into memory."""

    def __init__(self, langs: list[str], path: str):
        self.langs, self.path = langs, path

    @property
    def table(self) -> np.ndarray:
        import os

        from pyspark import SparkFiles

        here = self.path if os.path.exists(self.path) else SparkFiles.get(os.path.basename(self.path))
        return np.memmap(here, np.float32, "r", shape=(len(self.langs), 1 << BITS)) if self.langs else np.zeros((0, 1 << BITS), np.float32)

    @classmethod
    def fit(cls, labelled: DataFrame, *, per_lang: int = TRAIN_PER_LANG, seed: int = 11) -> LanguageModels:
        """From (doc_id, lang, text); per language about *per_lang* rows, chosen by a hash of the id.

        * null languages and texts are left out; empty texts teach nothing;
        * very long texts count whole; repeated rows and equal ids are chosen alike;
        * no row gives models without a language; further columns are ignored.
        """
        import tempfile

        spark = labelled.sparkSession
        ship(spark)
        labelled = labelled.where("lang is not null and text is not null").select("doc_id", "lang", F.col("text").cast("string").alias("text"))
        sizes = labelled.groupBy("lang").agg(F.count("*").alias("__n"))
        # a row a language
        chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
        chosen = labelled.join(F.broadcast(sizes), "lang").where(chance < F.lit(float(per_lang)) / F.col("__n")).select("lang", "text")
        counts = chosen.mapInArrow(count_batches, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        langs = []
        with tempfile.NamedTemporaryFile(prefix="tickloom-langs-", delete=False) as out:
            # in order of name, one at a time through the driver
            for r in counts.groupBy("lang").applyInArrow(model_rows, "lang string, row binary").orderBy("lang").toLocalIterator():
                langs.append(r["lang"])
                out.write(r["row"])
        # executors fetch it from the driver as long as the application lives
        atexit.register(lambda: os.path.exists(out.name) and os.unlink(out.name))
        if langs:
            spark.sparkContext.addFile(out.name)
        return cls(langs, out.name)


def mixture_of(loglik: np.ndarray | Callable[[], Iterable[np.ndarray]], penalty: float, rounds: int = 25) -> tuple[np.ndarray, list[int]]:
    """Proportions of languages (columns) that make the segments (rows), and the set chosen.

    *loglik* is a matrix, or a function that yields its rows in blocks, called
    again for each step: what is kept are the columns of chosen languages.

    The language tried next is the one with most to gain: the sum of what its
    segments' likelihoods are above the mixture's.  It stays if the mixture's
    log-likelihood gains more than *penalty*; the search ends when no language
    has that much to gain.  Ties go to the first column.
    """
    blocks = loglik if callable(loglik) else lambda: [loglik]
    total, tops = 0.0, []
    for part in blocks():
        total = total + part.sum(0)
        tops.append(part.max(1))
    top, k = np.concatenate(tops), len(total)
    best = float(top.sum())

    def column(c: int) -> np.ndarray:
        return np.exp(np.concatenate([part[:, c] for part in blocks()]) - top)[:, None] + 1e-30

    def em(p: np.ndarray) -> tuple[np.ndarray, float]:
        w = np.full(p.shape[1], 1 / p.shape[1])
        if p.shape[1] > 1:
            for _ in range(rounds):
                r = p * w
                r /= r.sum(1, keepdims=True)
                new = r.mean(0)
                if np.abs(new - w).max() < 1e-4:
                    w = new
                    break
                w = new
        return w, float(np.log(p @ w).sum() + best)

    chosen = [int(total.argmax())]
    like = column(chosen[0])
    weights, value = em(like)
    open_ = np.ones(k, bool)
    open_[chosen] = False
    while open_.any():
        now, gain, a = np.log(like @ weights) + top, np.zeros(k), 0
        for part in blocks():
            gain += np.maximum(part - now[a : a + len(part), None], 0).sum(0)
            a += len(part)
        room = np.where(open_, gain, -1.0)
        c = int(room.argmax())
        if room[c] <= penalty:
            break
        open_[c] = False
        more = np.concatenate([like, column(c)], axis=1)
        w, v = em(more)
        if v - value > penalty:
            chosen, weights, value, like = [*chosen, c], w, v, more
    out = np.zeros(k)
    out[chosen] = weights
    return out, chosen


def likelihoods(raw: np.ndarray, starts: np.ndarray, cut: np.ndarray, table: np.ndarray) -> Callable[[int, int], Iterable[np.ndarray]]:
    """A function that yields the log-likelihoods of segments a to b (rows) under the languages (columns), in blocks.

    *cut* are the segments' ends with a 0 before.  At most CELLS are held: of a
    text with more segments times languages they are computed again when asked for.
    """
    n, k = len(cut) - 1, len(table)
    step = max(1, min(CELLS // 8 // max(k, 1), BLOCK))

    def block(a: int, b: int) -> np.ndarray:
        out = np.zeros((b - a, k))
        full = np.flatnonzero(np.diff(cut[a : b + 1]))
        if len(full):
            # two bytes before belong to the first trigrams
            lead = max(0, int(cut[a]) - 2)
            grams, letter = _grams(raw[lead : cut[b]], starts - lead)
            at = cut[a:b][full] - lead
            for c in range(k):
                out[full, c] = np.add.reduceat(np.where(letter, table[c][grams], np.float32(0)).astype(np.float64), at)
        return out

    if n * k <= CELLS:
        held = np.concatenate([block(a, min(a + step, n)) for a in range(0, n, step)])
        return lambda a, b: [held[a:b]]
    return lambda a, b: (block(x, min(x + step, b)) for x in range(a, b, step))


def predict_batches(models: LanguageModels, text: str, penalty: float, schema: pa.Schema | None):
    """Add lang_pred, score, mixture to each batch."""
    langs = models.langs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = models.table
        for batch in batches:
            preds, scores, mixes = [], [], []
            column = batch.column(text)
            for i, j, raw, offsets in slices(column):
                # segments: equal cuts of each document, by its length
                lens = np.diff(offsets)
                n_seg = np.maximum(1, lens // SEGMENT)
                begin = np.concatenate([[0], np.cumsum(n_seg)])
                which = np.repeat(np.arange(j - i), n_seg)
                place = np.arange(begin[-1]) - begin[:-1][which]
                cut = offsets[:-1][which] + place * lens[which] // n_seg[which]
                cut = np.append(cut, len(raw))
                segments = likelihoods(raw, offsets[:-1], cut, table)
                for x in range(j - i):
                    a, b = offsets[x], offsets[x + 1]
                    has = _LETTER[raw[a:b]].any()
                    if has and not ((raw[a:b] | 32) - 97 < 26).any():
                        # no ASCII letter: a letter of another script, or only signs
                        has = any(ch.isalpha() for ch in raw[a:b].tobytes().decode("utf-8", "replace"))
                    if not has or not langs:
                        preds.append("und")
                        scores.append(0.0)
                        mixes.append([])
                        continue
                    w, chosen = mixture_of(partial(segments, begin[x], begin[x + 1]), penalty)
                    best = int(np.argmax(w))
                    preds.append(langs[best])
                    scores.append(float(w[best]))
                    mixes.append([{"lang": langs[c], "share": float(w[c])} for c in sorted(chosen, key=lambda c: -w[c])])
            cols = [batch.column(c) for c in batch.schema.names]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(mixes, kind)], [*batch.schema.names, "lang_pred", "score", "mixture"])

    return run


def identify(documents: DataFrame, models: LanguageModels, *, penalty: float = 6.0, text_col: str = "text") -> DataFrame:
    """The documents with lang_pred, score and mixture (language, share) added.

    * null text or text without a letter: ``und``, score 0, empty mixture; so
      is every text if the models hold no language;
    * very long texts are taken whole, in segments; ties go to the language
      first by name; repeated rows get equal results;
    * an empty table gives an empty result; input columns of the three names
      are replaced, others stay whatever their names, as rows are wrapped in
      one struct.
    """
    ship(documents.sparkSession)
    names = [c for c in documents.columns if c not in ("lang_pred", "score", "mixture")]
    work = documents.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    added = T.StructType.fromDDL("lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
    out = work.mapInArrow(predict_batches(models, "text", penalty, None), T.StructType([*work.schema.fields, *added.fields]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "lang_pred", "score", "mixture")
