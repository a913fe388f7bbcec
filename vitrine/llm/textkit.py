"""Vectorised text primitives over Arrow batches: words, hashes, shingles.

A chunk is a run of rows whose texts are viewed as one byte buffer. Words are runs of bytes
for which a 256-entry table is true; runs end at row boundaries. A word's hash is that of its
bytes only, so equal words hash alike in every chunk, task and run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are worked on at once: a task holds some eighty times as many in arrays.
CHUNK_BYTES = 1 << 18
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, U), np.ones(1, U)]

#: Bytes of `[a-z0-9]` and of every character beyond ASCII.
LOWER_WORD = np.zeros(256, bool)
LOWER_WORD[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8)] = True
LOWER_WORD[128:] = True
#: Everything but blank and \t \n \v \f \r.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[0x0A] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, modulo 2**64, for exponents below n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            x = np.full(n, base, U)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], by differences of one running polynomial."""
    n = len(values)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U)
    x = values.astype(U)
    x += U(1)
    x *= up[:n]
    np.cumsum(x, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


class Chunk:
    """Rows of a batch, their texts as one buffer: data[offsets[i]:offsets[i + 1]] is row i's."""

    def __init__(self, batch: pa.RecordBatch, column: str = "text", lower: bool = False):
        self.batch, self.rows = batch, batch.num_rows
        array = batch.column(column)
        if not pa.types.is_large_string(array.type):
            array = array.cast(pa.large_string())
        if array.null_count:
            array = pc.fill_null(array, "")
        if lower:
            array = pc.utf8_lower(array)
        offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + self.rows + 1] if self.rows else np.zeros(1, np.int64)
        data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.texts = array

    def runs(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs, and each row's first run (rows + 1 entries)."""
        inside = table[self.data]
        n = len(inside)
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        first = first[:n]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | first))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:] & ~first[1:]
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", lower: bool = False, most: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Every row once, in chunks of bounded bytes; a longer text is a chunk of its own."""
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
            yield Chunk(batch.slice(at, to - at), column, lower)
            at = to


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each item, from each row's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n successive items within a row, and the index of each one's first item."""
    last = len(hashes) - n + 1
    if last <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(last, U)
    for k in range(n):
        total *= _BASE
        total += hashes[k : k + last]
    whole = np.ones(last, bool)
    for b in first[1:-1]:
        whole[max(0, b - n + 1) : min(b, last)] = False
    at = np.flatnonzero(whole)
    return mix(total[at]), at


def shingles(hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word shingles: hashes, first words, rows. A row of fewer than n words, but one, is one shingle."""
    values, at = grams(hashes, first, n)
    rows = np.searchsorted(first, at, "right") - 1
    sizes = np.diff(first)
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        extra = []
        for r in short:
            total = U(0)
            with np.errstate(over="ignore"):
                for h in hashes[first[r] : first[r + 1]]:
                    total = total * _BASE + h
            extra.append(total)
        values = np.concatenate([values, mix(np.array(extra, U) ^ U(0x5555555555555555))])
        at = np.concatenate([at, first[short]])
        rows = np.concatenate([rows, short])
        order = np.argsort(at, kind="stable")
        values, at, rows = values[order], at[order], rows[order]
    return values, at, rows
