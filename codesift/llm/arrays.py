"""Array kernels shared by the operators: whole Arrow batches of texts as one byte buffer.

Nothing here loops over characters; the work per batch is a fixed number of numpy passes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# White space of the word rule [^\x20\x09-\x0D]+ (fixed values).
BLANKS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)

# Rows and bytes of one Arrow batch that a Python task gets at most (a longer row travels alone).
BATCH_ROWS = 10_000
BATCH_BYTES = 4 << 20

_BLANK = np.zeros(256, bool)
_BLANK[list(BLANKS)] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_SPAN = 1 << 18
_U = np.uint64


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches of this session small, so that a task's memory does not depend on text lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """Deal an input of fewer partitions than cores over all cores; large inputs pass as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A text column as (bytes, offsets); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset: column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]: offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or one row."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word in bytes, and the number of words before each text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    fresh = first.copy()
    fresh[1:-1] |= ~word[:-1]
    starts = np.flatnonzero(word & fresh[:-1])
    last = first[1:].copy()
    last[:-1] |= ~word[1:]
    last[-1] = True
    ends = np.flatnonzero(word & last) + 1
    return starts, ends, np.searchsorted(starts, offs)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (_BASE, inverse))
        return self.up, self.down


_POWERS = _Powers()


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span of bytes; spans are ascending and do not overlap.

    A polynomial hash from prefix sums, over runs of spans of a bounded number of bytes, so equal spans hash alike
    wherever they stand and memory stays bounded.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _SPAN, "right")))
        stop = int(ends[j - 1])
        up, down = _POWERS.of(max(stop - base, _SPAN))
        total = np.zeros(stop - base + 1, np.uint64)
        np.cumsum((data[base:stop].astype(np.uint64) + _U(1)) * up[: stop - base], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def gram_hashes(words: np.ndarray, woffs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows, text by text, and the number of windows before each text.

    A text with fewer words than ``n`` has one window of all its words; one without words has none.
    """
    counts = np.diff(woffs)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    goffs = np.concatenate([[0], np.cumsum(sizes)])
    coef = [_U(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(n)]
    total = max(len(words) - n + 1, 0)
    rolled = np.zeros(total, np.uint64)
    for j in range(n):
        rolled += words[j: j + total] * coef[j]
    out = np.empty(int(goffs[-1]), np.uint64)
    full = counts >= n
    if full.any():
        keep = np.zeros(len(words) + 1, np.int64)
        np.add.at(keep, woffs[:-1][full], 1)
        np.add.at(keep, woffs[1:][full] - n + 1, -1)
        into = np.repeat(full, sizes)
        out[into] = rolled[np.flatnonzero(np.cumsum(keep)[:total] > 0)]
    for d in np.flatnonzero((counts > 0) & ~full):
        own = words[woffs[d]: woffs[d + 1]]
        out[goffs[d]] = (own * np.array(coef[: len(own)], np.uint64)).sum(dtype=np.uint64) + _U(len(own))
    return mix(out), goffs


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text column and the number of words before each text."""
    data, offs = flat(column)
    starts, ends, woffs = word_bounds(data, offs)
    return span_hashes(data, starts, ends), woffs


def as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def binaries(parts: Iterable[bytes]) -> pa.Array:
    return pa.array(list(parts), pa.binary())
