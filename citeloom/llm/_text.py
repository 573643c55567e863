"""Vectorised words and shingles over Arrow string columns.

A word is a maximal run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return
(``[^\\x20\\x09-\\x0D]+``); since those are ASCII, runs of bytes and of code points agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_RANDOM = np.random.Generator(np.random.PCG64(20240229))
#: A random 64-bit value for each byte, and the odd base of the polynomial hash with its inverse modulo 2**64.
_BYTE = _RANDOM.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _RANDOM.integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit with probability near one half."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offset of each row, one more than rows."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text each; a longer single text is a part of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(start, end - start)
        start = end


@dataclass
class Words:
    """Words of a column: byte spans into ``data``, and for row i the words ``first[i]:first[i + 1]``."""

    data: np.ndarray
    rows: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word's bytes, ASCII letters lower-cased first if asked."""
        data = LOWER[self.data] if lower else self.data
        n = len(data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(_BASE, n), out=total[1:])
        spans = (total[self.end] - total[self.start]) * _power(_INVERSE, n)[self.start] if n else total[:0]
        return mix(spans + (self.end - self.start).astype(np.uint64))


def words(column: pa.Array) -> Words:
    data, rows = utf8(column)
    inside = ~SPACE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    filled = rows[:-1] < rows[1:]
    before[rows[:-1][filled]] = False
    after[rows[1:][filled] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, rows, start, end, np.searchsorted(start, rows))


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``n``-word shingles, ASCII letters lower-cased.

    Fewer than ``n`` words: the whole sequence is one shingle. No words: empty.
    """
    found = words(column)
    h = found.hashes()
    first = found.first
    if len(h) >= n:
        rolled = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            rolled += h[k : len(h) - n + 1 + k] * _PLACE[k]
        rolled = mix(rolled)
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            yield np.unique(rolled[a : b - n + 1])
        elif b > a:
            yield mix((h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


class Lookup:
    """A map from distinct 64-bit keys to their positions, found for whole arrays through an open hash table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(np.uint64)
        bits = max(8, int(len(keys)).bit_length() + 2)
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(self.keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.last

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The position of each key, -1 if it is none of the keys."""
        at = self._home(keys)
        out = self.slots[at]
        if not len(self.keys):
            return out
        todo = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.last
            out[todo] = self.slots[at[todo]]
            found = out[todo]
            todo = todo[(found >= 0) & (self.keys[found] != keys[todo])]
        return out


def ragged(values: np.ndarray, first: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[first[i]:first[i + 1]]`` for i in ``pick``, joined, and where each begins (one more at the end)."""
    size = (first[1:] - first[:-1])[pick]
    ends = np.concatenate([[0], np.cumsum(size)])
    return values[np.repeat(first[:-1][pick] - ends[:-1], size) + np.arange(ends[-1])], ends
