"""Word shingles of texts as sorted sets of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .rolling import U64, Poly, mix, text_slices

WIDTH = 5
_POLY = Poly(11)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PLACES = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.int64).astype(U64) | U64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts of a slice, and where each text's words begin among them."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(~space & (before | first[:-1]))
    ends = np.flatnonzero(~space & (after | first[1:])) + 1
    sums = _POLY.sums(_LOWER[data])
    words = mix(_POLY.ranges(sums, starts, ends) + (ends - starts).astype(U64) * _PLACES[63])
    return words, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; empty without words.

    With fewer words than ``width`` the whole sequence is the one shingle.
    """
    for _, _, data, offsets in text_slices(column):
        words, at = word_hashes(data, offsets)
        n = len(words) - width + 1
        whole = np.zeros(max(n, 0), U64)
        for j in range(width if n > 0 else 0):
            whole += words[j : j + n] * _PLACES[j]
        whole = mix(whole)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= width:
                s = np.sort(whole[a : b - width + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
            elif b > a:
                yield mix((words[a:b] * _PLACES[: b - a]).sum(keepdims=True) + U64(b - a) * _PLACES[62])
            else:
                yield whole[:0]
