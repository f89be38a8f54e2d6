"""Vectorised text kernels shared by the Python-side operators.

All kernels see a batch of texts as one byte buffer plus document offsets, so
the per-word work is a handful of array passes and no Python object is made for
a word.  Texts are taken whole; a batch is cut between documents only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once (one document may be longer).
SLICE_BYTES = 1 << 20

_U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POW = np.ones(1, _U64)
_INV = np.ones(1, _U64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (xor-shift and odd multiplications)."""
    x = x ^ (x >> _U64(33))
    x *= _U64(0xFF51AFD7ED558CCD)
    x ^= x >> _U64(33)
    x *= _U64(0xC4CEB9FE1A85EC53)
    x ^= x >> _U64(33)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=_U64) * _U64(0xD1342543DE82EF95))


def _powers(n: int) -> None:
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, SLICE_BYTES + 4096)
        for base, name in ((_P, "_POW"), (_PINV, "_INV")):
            out = np.ones(n, _U64)
            out[1:] = _U64(base)
            globals()[name] = np.multiply.accumulate(out)


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array without nulls (null becomes empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first, last, bytes, offsets) of runs of documents of about *limit* bytes.

    offsets has one entry more than the run has documents and starts at 0.
    """
    column = texts_of(column)
    if not len(column):
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, len(column))
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross documents."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[cuts] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over 2^64 by prefix sums, then mixed."""
    if not len(starts):
        return np.zeros(0, _U64)
    _powers(len(raw) + 1)
    total = np.empty(len(raw) + 1, _U64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * _POW[: len(raw)], out=total[1:])
    value = (total[ends] - total[starts]) * _INV[starts]
    return mix64(value + (ends - starts).astype(_U64))


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` and, per document, the first word's index."""
    if lower:
        raw = LOWER[raw]
    starts, ends = runs(~SPACE[raw], offsets)
    return span_hash(raw, starts, ends), np.searchsorted(starts, offsets)
