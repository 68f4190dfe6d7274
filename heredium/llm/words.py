"""Words and word n-grams of whole Arrow batches as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D. Word and n-gram hashes are
polynomials modulo 2**64, read off prefix sums, so that a batch costs a fixed number of array
passes and no Python object per word. Work goes slice by slice to bound memory; a document is
never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (in place)."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=U64)


class _Tables:
    """Powers of the base and of its inverse, as long as the longest slice so far."""

    def __init__(self):
        self.up, self.down = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)
        self.byte = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
        space = np.zeros(256, dtype=bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        self.visible = ~space

    def need(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)


_TABLES: list[_Tables] = []


def tables(n: int) -> _Tables:
    if not _TABLES:
        _TABLES.append(_Tables())
    _TABLES[0].need(n + 1)
    return _TABLES[0]


@dataclass
class Words:
    """``hash`` per word; document ``i`` of the slice holds words ``first[i]:first[i + 1]``."""

    hash: np.ndarray
    first: np.ndarray

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        n = len(self.hash)
        return np.repeat(self.first[1:], np.diff(self.first)) - np.arange(n)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """``raw``: bytes of the documents one after another; ``offsets``: where each begins, and the end."""
    t, n = tables(len(raw)), len(raw)
    if n == 0:
        return Words(np.empty(0, U64), np.zeros(len(offsets), np.int64))
    seen = t.visible[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, seen[:-1]
    start = np.flatnonzero(seen & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, seen[1:]
    end = np.flatnonzero(seen & (~after | edge[1:])) + 1
    total = np.empty(n + 1, dtype=U64)
    total[0] = 0
    np.cumsum(t.byte[raw] * t.up[:n], out=total[1:])
    h = (total[end] - total[start]) * t.down[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407)
    return Words(mix(h), np.searchsorted(start, offsets).astype(np.int64))


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``k`` words from each position on; the last k - 1 positions are left out."""
    n = len(h)
    if n < k:
        return np.empty(0, U64)
    t = tables(n)
    total = np.empty(n + 1, dtype=U64)
    total[0] = 0
    np.cumsum((h if not seed else mix(h + U64(seed))) * t.up[:n], out=total[1:])
    g = (total[k:] - total[:-k]) * t.down[: n - k + 1]
    g += U64((k * 0x9FB21C651E98DF25) & 0xFFFFFFFFFFFFFFFF)
    return mix(g)


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of pieces of a string column; null counts as empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, raw[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        lo = hi


def sums_by_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i + 1]]`` for each document, 0 for an empty one."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]
