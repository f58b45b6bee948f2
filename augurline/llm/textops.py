"""Words of many texts at once, as positions and 64-bit fingerprints in NumPy arrays.

A word's fingerprint is a polynomial in a fixed odd base over fixed pseudo-random byte values, modulo 2**64, and then mixed.
Two different words share one with a probability of about 2**-60; operators that rest on fingerprints say so.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
SEGMENT = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; x isn't kept."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


VALUES = mix((np.arange(256, dtype=U64) + U64(1)) * U64(BASE))
LOWERED = VALUES.copy()
LOWERED[65:91] = VALUES[97:123]
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SEGMENT)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def hashed(data: np.ndarray, start: np.ndarray, stop: np.ndarray, values: np.ndarray = LOWERED) -> np.ndarray:
    """Fingerprints of the byte ranges [start, stop) of data; the ranges ascend and don't overlap."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + SEGMENT)))
        first, last = int(start[i]), int(stop[j - 1])
        up, down = _power_tables(last - first)
        sums = np.empty(last - first + 1, U64)
        sums[0] = 0
        np.cumsum(values[data[first:last]] * up[: last - first], out=sums[1:])
        s = start[i:j] - first
        out[i:j] = (sums[stop[i:j] - first] - sums[s]) * down[s]
        i = j
    return mix(out)


def combined(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of n words."""
    total = np.zeros(max(0, len(words) - n + 1), U64)
    for k in range(n):
        total += words[k : k + len(total)] * U64(pow(BASE, 2 * k + 3, 1 << 64))
    return mix(total)


class Texts:
    """Some whole texts: bytes, where each text begins, where words begin and end, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        word = ~SPACE[data]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        begins[inner] = word[inner]
        ends[inner - 1] = word[inner - 1]
        self.start, self.stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def words(self, lowered: bool = True) -> np.ndarray:
        return hashed(self.data, self.start, self.stop, LOWERED if lowered else VALUES)

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def counted(self, table: np.ndarray) -> np.ndarray:
        """For each text the number of bytes for which table is true."""
        sums = np.zeros(len(self.data) + 1, np.int64 if len(self.data) >> 31 else np.int32)
        np.cumsum(table[self.data], out=sums[1:])
        return np.diff(sums[self.offsets].astype(np.int64))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, Texts]]:
    """The texts of a column in slices of about `most` bytes and one text at least: (first row, end row, texts)."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, j, Texts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def trimmed(task: Callable) -> Callable:
    """The task, giving freed memory back to the system when it ends: idle workers stay alive beside busy ones."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text and one row at least."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        _, offsets = buffers(batch.column(at))
        n, i = len(offsets) - 1, 0
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
            yield batch.slice(i, j - i)
            i = j
