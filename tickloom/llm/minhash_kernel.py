"""Circulant MinHash of word shingles, in arrays."""

from __future__ import annotations

import numpy as np

from tickloom.llm.kernels import mix64, words

_U64, _U32 = np.uint64, np.uint32


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word shingles and, per document, the first one's index.

    A document with one to ``width - 1`` words has its whole word sequence as
    its one shingle; one without words has none.
    """
    word, first = words(raw, offsets)
    count = np.diff(first)
    n = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=begin[1:])
    if not begin[-1]:
        return np.zeros(0, _U64), begin
    # position of each shingle's first word
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n)
    padded = np.concatenate([word, np.zeros(width, _U64)])
    short = np.repeat(count < width, n)
    length = np.repeat(np.minimum(count, width), n)
    out = np.zeros(begin[-1], _U64)
    for k in range(width):
        term = padded[at + k]
        if short.any():
            term = np.where(length > k, term, _U64(0))
        out = mix64(out * _U64(0x9DDFEA08EB382D69) + term + _U64(k + 1))
    return mix64(out + length.astype(_U64)), begin


def permute(x: np.ndarray) -> np.ndarray:
    """The circulant permutation: a bijection of the 2^32 slots."""
    x = x ^ (x >> _U32(16))
    x *= _U32(0x7FEB352D)
    x ^= x >> _U32(15)
    x *= _U32(0x846CA68B)
    x ^= x >> _U32(16)
    return x


def scatter(x: np.ndarray) -> np.ndarray:
    """The initial permutation, applied once so that shifts meet no structure."""
    x = x * _U32(0x9E3779B1)
    x ^= x >> _U32(15)
    x *= _U32(0x2C1B3C6D)
    x ^= x >> _U32(13)
    x *= _U32(0x297A2D39)
    x ^= x >> _U32(16)
    return x


def signatures(shingles: np.ndarray, begin: np.ndarray, coordinates: int) -> np.ndarray:
    """documents x coordinates; coordinate k is the least ``permute(scatter(s) + k)``.

    The two permutations are fixed, the second shifted circularly by k (mod
    2^32).  Documents without shingles get the largest value throughout.
    """
    out = np.full((len(begin) - 1, coordinates), 0xFFFFFFFF, _U32)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        slot = scatter((shingles >> _U64(32)).astype(_U32))
        at = begin[:-1][full]
        for k in range(coordinates):
            out[full, k] = np.minimum.reduceat(permute(slot + _U32(k)), at)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """documents x bands; a 64-bit key of each band's coordinates and its number."""
    n, k = signature.shape
    groups = signature[:, : k - k % rows].reshape(n, -1, rows).astype(_U64)
    key = np.broadcast_to(np.arange(1, groups.shape[1] + 1, dtype=_U64), groups.shape[:2]) * _U64(0xA0761D6478BD642F)
    for r in range(rows):
        key = mix64(key * _U64(0x9DDFEA08EB382D69) + groups[:, :, r])
    return key
