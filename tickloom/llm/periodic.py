"""Runs of repeated phrases: every maximal periodic stretch of words, on a harmonic grid.

A stretch of words has period q if words q apart are identical; it is a run if q
is its smallest period, it is ``power`` periods and ``least`` words long or
longer, and no neighbouring word goes on with that period.  The words whose next
one at distance q is the same are then a stretch of at least
max(least, power q) - q places, so a grid with that spacing hits every run: over
all periods the grids have n log n places together.  At each place where the two
words agree, the longest common extension of the word and its partner is found
to both sides by binary search on prefix hashes, for all (period, place) pairs of
many documents at once.  What is found is compared word by word, byte by byte,
and the runs that several places or multiples of a period have found are taken
once, under their smallest period.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.kernels import SPACE, runs, slices, span_hash
from tickloom.llm.scratch import ship

_U64 = np.uint64
#: Two primes below 2^31 and a base for each: products and sums of remainders fit 64 bits.
PRIMES, BASES = (2147483647, 2147483629), (1204960597, 1792413371)
#: Pairs of period and place that are looked at together, and bytes compared together.
PAIRS, COMPARED = 1 << 20, 1 << 24

_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each prime the first *n* powers of its base and of the base's inverse."""
    if not _powers or len(_powers[0][0]) < n:
        _powers.clear()
        for p, base in zip(PRIMES, BASES, strict=True):
            both = []
            for b in (base, pow(base, -1, p)):
                out = np.ones(1, _U64)
                while len(out) < n:
                    out = np.concatenate([out, out * _U64(pow(b, len(out), p)) % _U64(p)])
                both.append(out)
            _powers.append((both[0], both[1]))
    return _powers


class PrefixHash:
    """Hashes of any stretch of a sequence of 64-bit values, by prefix sums modulo two primes."""

    def __init__(self, values: np.ndarray):
        self.tables = []
        for (power, inverse), p in zip(powers(len(values) + 1), PRIMES, strict=True):
            total = np.zeros(len(values) + 1, _U64)
            np.cumsum(values % _U64(p) * power[: len(values)] % _U64(p), out=total[1:])
            self.tables.append((total % _U64(p), inverse, _U64(p)))

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches from a and from b (after a) look alike; equal ones always do."""
        out = np.ones(len(a), bool)
        for total, inverse, p in self.tables:
            x = (total[a + length] + p - total[a]) % p * inverse[a] % p
            y = (total[b + length] + p - total[b]) % p * inverse[b] % p
            out &= x == y
        return out


def extension(hashes: PrefixHash, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Longest common extension of places a and b, of at most *most* words after them (or before them), by one binary search for all."""
    low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
    while len(on := np.flatnonzero(low < high)):
        mid = (low[on] + high[on] + 1) >> 1
        ahead = mid if back else 0
        same = hashes.equal(a[on] - ahead, b[on] - ahead, mid)
        low[on[same]], high[on[~same]] = mid[same], mid[~same] - 1
    return low


def grid(lengths: np.ndarray, starts: np.ndarray, least: int, power: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, period, document's start, document's end) of the grids of all documents, PAIRS at a time or one period's."""
    top = int(lengths.max(initial=0)) // power
    held, n = [], 0
    for q in range(1, top + 1):
        size = max(least, power * q)
        docs = np.flatnonzero(lengths >= size)
        if not len(docs):
            break
        step = size - q
        # places p with p + q inside the document, from step - 1 on so that the first stretch is met at its end at the latest
        count = (lengths[docs] - q) // step
        doc = np.repeat(docs, count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        held.append((starts[doc] + step - 1 + nth * step, np.full(len(doc), q, np.int64), starts[doc], starts[doc] + lengths[doc]))
        n += len(doc)
        if n >= PAIRS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def runs_of(values: np.ndarray, first: np.ndarray, least: int, power: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the runs of documents that begin at *first* (one entry more than documents), by start, then period."""
    hashes = PrefixHash(values)
    found = [np.zeros((0, 3), np.int64)]
    for place, q, begin, end in grid(np.diff(first), first[:-1], least, power):
        near = np.flatnonzero(values[place] == values[place + q])
        place, q, begin, end = place[near], q[near], begin[near], end[near]
        before = extension(hashes, place, place + q, place - begin, back=True)
        after = extension(hashes, place, place + q, end - place - q, back=False)
        start, stop = place - before, place + q + after
        long_ = stop - start >= np.maximum(least, power * q)
        found.append(np.unique(np.stack([start[long_], stop[long_], q[long_]], 1), axis=0))
    every = np.unique(np.concatenate(found), axis=0)
    # one stretch under several periods is a run of the smallest, which divides the others
    keep = np.append(True, (every[1:, :2] != every[:-1, :2]).any(1)) if len(every) else np.zeros(0, bool)
    every = every[keep]
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    return every[:, 0], every[:, 1], every[:, 2]


def _spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For stretches of *lengths*: the stretch of each of their places, and the place in it."""
    which = np.repeat(np.arange(len(lengths)), lengths)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def differing(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b (numbers of spans of *raw*) differ in a byte."""
    size = ends[a] - starts[a]
    out = size != ends[b] - starts[b]
    size = np.where(out, 0, size)
    cut = np.searchsorted(np.cumsum(size), np.arange(COMPARED, int(size.sum()) + COMPARED, COMPARED), "left") + 1
    lo = 0
    for hi in np.minimum(cut, len(a)).tolist():
        which, at = _spread(size[lo:hi])
        if len(which):
            bad = raw[starts[a[lo:hi]][which] + at] != raw[starts[b[lo:hi]][which] + at]
            out[lo + which[bad]] = True
        lo = max(lo, hi)
    return out


def wrong_documents(raw, starts, ends, first, start, stop, q) -> np.ndarray:
    """Documents of which a run claims equal words that differ: two words or stretches had one hash."""
    bad = []
    for lo in range(0, len(start), 1 << 14):
        part = slice(lo, lo + (1 << 14))
        which, at = _spread(stop[part] - start[part] - q[part])
        a = start[part][which] + at
        bad.append(a[differing(raw, starts, ends, a, a + q[part][which])])
    return np.unique(np.searchsorted(first, np.concatenate(bad or [np.zeros(0, np.int64)]), "right") - 1)


def exact_runs(words: list[bytes], least: int, power: int) -> np.ndarray:
    """Runs of one document without hashes, a pass for each period: what is done where hashes met."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    out: dict[tuple[int, int], int] = {}
    for q in range(1, len(ids) // power + 1):
        same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), (edge[1::2] + q).tolist(), strict=True):
            if e - s >= max(least, power * q):
                out.setdefault((s, e), q)
    return np.array(sorted((s, e, q) for (s, e), q in out.items()), np.int64).reshape(-1, 3)[:, :3]


def collapsed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each document with one space between them."""
    # the byte before a word that is not its text's first is white space, and may be the space between
    raw, words = raw.copy(), np.flatnonzero(kept)
    doc = np.searchsorted(first, words, "right") - 1
    opens = np.append(True, doc[1:] != doc[:-1]) if len(words) else np.zeros(0, bool)
    raw[starts[words[~opens]] - 1] = 0x20
    step = np.zeros(len(raw) + 1, np.int8)
    np.add.at(step, starts[words] - ~opens, 1)
    np.add.at(step, ends[words], -1)
    out = raw[np.cumsum(step[:-1], dtype=np.int8) > 0]
    size = np.bincount(doc, ends[words] - starts[words] + ~opens, len(first) - 1).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))


def run_batches(least: int, power: int):
    """(key, text) to (key, n_words, starts, lengths, periods, collapsed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            for i, j, raw, offsets in slices(batch.column("text")):
                starts, ends = runs(~SPACE[raw], offsets)
                first = np.searchsorted(starts, offsets)
                values = span_hash(raw, starts, ends)
                start, stop, q = runs_of(values, first, least, power)
                for d in wrong_documents(raw, starts, ends, first, start, stop, q).tolist():
                    again = exact_runs(raw[offsets[d] : offsets[d + 1]].tobytes().split(), least, power) + [first[d], first[d], 0]
                    rest = (start < first[d]) | (start >= first[d + 1])
                    every = np.concatenate([np.stack([start, stop, q], 1)[rest], again])
                    start, stop, q = every[np.lexsort((every[:, 2], every[:, 0]))].T
                doc = np.searchsorted(first, start, "right") - 1
                step = np.zeros(len(starts) + 1, np.int64)
                np.add.at(step, start + q, 1)
                np.add.at(step, stop, -1)
                text = collapsed(raw, starts, ends, first, np.cumsum(step[:-1]) == 0)
                at = pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int64))) for x in (start - first[doc], stop - start, q)]
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), pa.array(np.diff(first)), *lists, text.cast(pa.string())], ["key", "n_words", "starts", "lengths", "periods", "collapsed"])

    return run


def periodic_runs(documents: DataFrame, *, least: int = 6, power: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, runs, collapsed): the periodic runs of every whole text, and the text without their repeats.

    runs is an array of (start, length, period) in words, by start, then period;
    collapsed has the words that no run holds after its first period, with one
    space between them.  Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte.

    * null, empty and blank texts have no words, no runs and an empty collapsed text;
    * very long texts are searched whole: n log n places, PAIRS at a time, in one task a text;
    * ties: a stretch that has several periods is one run, of the smallest;
    * repeated rows and null ids: a row of the result for each row;
    * an empty table gives an empty result; further columns are ignored.
    """
    if least < 2 or power < 2:
        raise ValueError("a run has two words and two periods at least")
    ship(documents.sparkSession)
    given = documents.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = given.schema["key"].dataType.simpleString()
    out = given.mapInArrow(run_batches(least, power), f"key {kind}, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string")
    each = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.struct(r["starts"].alias("start"), r["lengths"].alias("length"), r["periods"].alias("period")))
    return out.select(F.col("key").alias(id_col), "n_words", each.alias("runs"), "collapsed")
