"""Vectorised helpers over Arrow string columns: flat bytes, word hashes, shingle sets.

All of them run inside a task on one Arrow batch at a time, in blocks of a few megabytes of text,
so that memory follows the longest single text and not the partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK_BYTES = 2_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One random word per byte value, and the same with A-Z read as a-z.
BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_CODES = BYTE_CODES[LOWER]


def _power(n: int, inverse: bool = False) -> np.ndarray:
    """Multiplier (or its inverse modulo 2**64) to the powers 0..n-1."""
    key = "inverse" if inverse else "plain"
    if key not in _powers or len(_powers[key]) < n:
        base = pow(int(_MULTIPLIER), -1, 2**64) if inverse else int(_MULTIPLIER)
        factors = np.full(max(n, BLOCK_BYTES + 1), base, dtype=np.uint64)
        factors[0] = 1
        _powers[key] = np.cumprod(factors)
    return _powers[key][:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``limit`` bytes together; a longer text comes alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def prefix_sums(data: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Running polynomial sums, so that any substring's hash is one subtraction away."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * _power(len(data)), out=sums[1:])
    return sums


def substring_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * _power(len(sums), inverse=True)[starts])


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Starts and ends of the maximal runs of word bytes, none across texts; and per text the
    range of its words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes that are not white space: space, tab, line feed, vertical tab, form feed, return.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int):
    """Hash of every run of ``width`` white-space-separated words (A-Z lowered) of every text, and
    the offsets per text. A text of fewer words has its whole sequence as the only one."""
    starts, ends, words = word_bounds(data, offsets, NOT_SPACE)
    hashes = substring_hashes(prefix_sums(data, LOWER_CODES), starts, ends)
    salts = mix(np.arange(1, width + 1, dtype=np.uint64))
    counts = np.diff(words)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    run = np.full(len(hashes), width, np.uint64)
    for k in range(width):
        run[:len(hashes) - k] += mix(hashes[k:] ^ salts[k])
    keep = np.zeros(len(hashes), bool)
    if len(hashes):
        last = words[1:] - width  # last start of a full run in each text
        position = np.arange(len(hashes))
        keep = position <= np.repeat(last, counts)
    out = np.empty(bounds[-1], np.uint64)
    full = np.repeat(counts >= width, sizes)
    out[full] = run[keep]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        own = hashes[words[i]:words[i + 1]]
        total = np.uint64(len(own))
        for k, h in enumerate(own):
            total = total + mix(np.array([h ^ salts[k]]))[0]
        out[bounds[i]] = total
    return mix(out), bounds


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` of a function from one record batch to some."""

    def run(batches):
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)
