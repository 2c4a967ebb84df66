"""Text columns as numpy bytes, words as 64-bit hashes, and a few column helpers.

Everything works on whole Arrow batches in slices of bounded bytes; a single text that is
longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
# odd constants of the multiplicative hashes (any odd values do)
STEP = 0x9E3779B97F4A7C15
BASE = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1


def text_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    if lower:
        filled = pc.utf8_lower(filled)
    _, offsets, data = filled.buffers()
    bounds = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose bytes stay below ``limit``, or single rows."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), rows)
        yield at, to
        at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shifts and odd multipliers)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit values as numbers in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(STEP))


@lru_cache(1)
def _word_bytes() -> np.ndarray:
    """ASCII letters and digits and all bytes of longer characters belong to words."""
    b = np.arange(256)
    return ((b >= 48) & (b <= 57)) | ((b >= 97) & (b <= 122)) | ((b >= 65) & (b <= 90)) | (b >= 128)


@lru_cache(1)
def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(length, BASE, np.uint64), np.full(length, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of the texts in words).

    A word's hash is a polynomial over its bytes, taken from one running sum. ``letters``
    says of each byte whether it belongs to words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = (_word_bytes() if letters is None else letters)[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(inside & (border[:n] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (border[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    up, down = _powers(max(2 * SLICE_BYTES, 1 << int(n).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values()[data] * up[:n], out=total[1:])
    hashes = mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def spans(offsets: np.ndarray) -> np.ndarray:
    """For each element, the number of its group, from the groups' offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def grams(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of each run of ``size`` words that stays inside its text."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = spans(offsets)
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        total = total * np.uint64(BASE) + hashes[at + k]
    return mixed(total), at


def id_hash(column: Column) -> Column:
    """crc32 of an id's decimal text, as the folds of the queries use it."""
    return F.crc32(column.cast("string").cast("binary"))
