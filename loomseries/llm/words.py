"""Words, lines and hashes of whole text columns, as numpy arrays over the Arrow buffers.

A batch of texts is one array of bytes with the place where each text starts.
Words are runs of bytes other than the ASCII blanks (0x20, 0x09-0x0D); a word
never runs over the end of its text. Hashes have 64 bits: a polynomial over
the bytes, taken from running sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

# Texts are handled in pieces of about this size, which bounds the temporary arrays.
PIECE_BYTES = 1 << 19
PIECE_ROWS = 4096

BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def text_batches(spark: SparkSession) -> None:
    """From now on rows go to Python in batches that suit texts: a task holds few of them at once."""
    spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


@contextmanager
def small_batches(spark: SparkSession):
    """The same for what runs inside."""
    before = spark.conf.get(BATCH_KEY)
    text_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly; equal numbers stay equal."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers of ``x``, sorted."""
    x = np.sort(x)
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return x[new]


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, 2, ... modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE_BYTES)
        _powers["up"] = _power(_BASE, size)
        _powers["down"] = _power(pow(_BASE, -1, 1 << 64), size)
    return _powers["up"], _powers["down"]


class Texts:
    """Some texts in a row: their bytes, and the byte at which each starts (one entry more than texts)."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        self._sums = None

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def lowered(self) -> Texts:
        """With A-Z as a-z."""
        return Texts(LOWER[self.data], self.bounds)

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each run of bytes of which ``inside`` is true; runs end with their text."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = self.bounds[(self.bounds > 0) & (self.bounds < len(inside))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
        return np.flatnonzero(first), np.flatnonzero(last) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~BLANK[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        r"""Start and end of each \n-split line, empty ones too; an empty text has one empty line."""
        ends = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.bounds[:-1], ends + 1]), kind="stable")
        return starts, np.sort(np.concatenate([ends, self.bounds[1:]]), kind="stable")

    def owner(self, starts: np.ndarray) -> np.ndarray:
        """The text that each (nonempty) run belongs to."""
        return np.searchsorted(self.bounds, starts, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each run of bytes; an empty run has the hash 0."""
        n = len(self.data)
        up, down = _tables(n + 1)
        if self._sums is None:
            self._sums = np.zeros(n + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * down[starts])


def texts_of(column: pa.Array, piece: int = PIECE_BYTES, rows: int = PIECE_ROWS) -> Iterator[tuple[int, Texts]]:
    """Pieces of a string column, each with the number of its first row. NULL counts as an empty text."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + piece, side="right")) - 1)
        end = min(end, row + rows, len(column))
        yield row, Texts(data[at[row] : at[end]], at[row : end + 1] - at[row])
        row = end


def grams(hashes: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """Hash of the n neighbouring hashes from each place in ``at`` on."""
    total = np.zeros(len(at), np.uint64)
    for i in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[at + i]
    return mix(total + np.uint64(n))


def sequence_hashes(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Hash of the hashes between each two neighbouring ``cuts``, which depends on their order."""
    n = len(hashes)
    up, down = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(hashes + np.uint64(_BASE)) * up[:n], out=sums[1:])
    return mix((sums[cuts[1:]] - sums[cuts[:-1]]) * down[cuts[:-1]] + np.diff(cuts).astype(np.uint64))


def binary_rows(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow binary column."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = (np.arange(len(rows) + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def matrix_of(column: pa.Array, dtype, width: int) -> np.ndarray:
    """The inverse of ``binary_rows``; every value must have the full width."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(dtype).itemsize * width
    if not len(column):
        return np.zeros((0, width), dtype)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[0] + size * len(column)].view(dtype).reshape(-1, width)
