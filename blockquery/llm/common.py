"""Byte-level numpy primitives shared by the text operators.

All of them work on bounded slices of an Arrow batch, so that a worker's memory
depends on the slice size and on the longest single text, not on the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 512 << 10
BATCH_ROWS = 512

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of at most ``BATCH_ROWS`` rows where it was left at more.

    Rows here are whole texts or packed blobs: the default of 10,000 rows a batch is
    held once by the executor and once by the worker, 100 MB each for rows of 10 KB.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return spark


def mix64(x: np.ndarray) -> np.ndarray:
    """Public splitmix64 finaliser over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown by doubling."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = np.empty(size, np.uint64)
        out[0] = 1
        filled, step = 1, base
        while filled < size:
            np.multiply(out[:filled], np.uint64(step), out=out[filled : 2 * filled])
            filled *= 2
            step = step * step % (1 << 64)
        _powers[base] = have = out
    return have[:n]


def forget_powers(limit: int = 1 << 22) -> None:
    """Drop power tables that one very long text has made large."""
    for base in [b for b, t in _powers.items() if len(t) > limit]:
        del _powers[base]


class PrefixHash:
    """Hashes of arbitrary byte spans from one prefix sum, equal for equal bytes at any position."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        terms = _BYTE_CODE[data]
        terms *= _power_table(_BASE, max(n, 1))[:n]
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.prefix[1:])
        self.inverse = _power_table(_BASE_INVERSE, n + 1)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix64(raw + (end - start).astype(np.uint64) * _MULTIPLIER)


def text_column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    """A text column as one large_string array with nulls as empty texts."""
    column = batch.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array, without copying the bytes."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together; a longer text stands alone, whole."""
    _, offsets = column_bytes(texts)
    start, n = 0, len(texts)
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts after lower-casing A-Z."""

    def __init__(self, texts: pa.Array):
        data, self.offsets = column_bytes(texts)
        self.data = _LOWER[data]
        n = len(data)
        inside = ~_SEPARATOR[data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        begins = inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | first[1:n]
        ends = inside.copy()
        if n:
            ends[:-1] &= ~inside[1:] | first[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        #: word index at which each text begins
        self.bounds = np.searchsorted(self.start, self.offsets)

    def hashes(self) -> np.ndarray:
        return PrefixHash(self.data).spans(self.start, self.end)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.bounds))


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """Per text, its sorted distinct ``width``-word shingle hashes; fewer words form one shingle."""
    hashes = words.hashes()
    total = len(hashes)
    if total >= width:
        rolled = np.zeros(total - width + 1, np.uint64)
        for k in range(width):
            rolled = (rolled ^ hashes[k : total - width + 1 + k]) * _MULTIPLIER
            rolled ^= rolled >> np.uint64(29)
        rolled = mix64(rolled)
    out = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            value = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in hashes[a:b]:
                    value = (value ^ h) * _MULTIPLIER
                    value ^= value >> np.uint64(29)
            out.append(mix64(np.array([value ^ np.uint64(0x5851F42D4C957F2D)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
