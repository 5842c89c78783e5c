"""Vectorised hashes over the bytes of many texts at once.

The texts of an Arrow column lie in one buffer; the functions here work on
slices of it, so no text becomes a Python object.  Hashes are polynomial prefix
sums modulo 2^64 over a random table of bytes: the hash of any range comes from
two of the sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text worked on at once; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 20


def _odd(seed: int) -> int:
    return int(np.random.default_rng(seed).integers(1 << 62, dtype=np.int64)) * 2 + 1


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class Poly:
    """One family of range hashes: a byte table, a base and its inverse."""

    def __init__(self, seed: int):
        self.table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)
        self.base, self.back = _odd(seed + 1), _inverse(_odd(seed + 1))
        self._up = self._down = np.ones(1, U64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            size = max(n, SLICE_BYTES + 1)
            up, down = np.full(size, self.base, U64), np.full(size, self.back, U64)
            up[0] = down[0] = 1
            self._up, self._down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self._up, self._down

    def sums(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums, one more than there are bytes."""
        out = np.zeros(len(data) + 1, U64)
        np.cumsum(self.table[data] * self._powers(len(data) + 1)[0][: len(data)], out=out[1:])
        return out

    def ranges(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (sums[ends] - sums[starts]) * self._powers(len(sums))[1][starts]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of runs of rows; nulls are empty.  ``offsets`` start at 0 in ``bytes``."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1 + column.offset)[column.offset :]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, whole[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end
