"""Vectorised text helpers for Arrow batches: whole UTF-8 texts as one byte array, words and hashes of spans.

Everything here runs inside a task on one bounded slice of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on at once; a longer text makes a slice of its own.
SLICE_BYTES = 2 << 20
# Rows in a slice, so that a row's number takes 14 bits.
SLICE_ROWS = 1 << 14
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


# A random 64-bit number per byte value; the second table reads A-Z as a-z.
BYTE_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_CODES = BYTE_CODES[LOWER]
# Word bytes: digits, letters and every byte of a character outside ASCII.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class SpanHash:
    """64-bit hashes of any spans of one array, from one running sum.

    The sum weighs position t by a power of an odd number; a span's difference is shifted back by the inverse
    power, so that equal contents get equal hashes wherever they stand.
    """

    def __init__(self, codes: np.ndarray):
        n = 1 << max(16, (len(codes) + 1).bit_length())
        self._back = _powers(_BASE_INVERSE, n)
        self._sum = np.zeros(len(codes) + 1, dtype=_U)
        with np.errstate(over="ignore"):
            np.cumsum(codes * _powers(_BASE, n)[: len(codes)], out=self._sum[1:])

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all spans of ``size``, in order."""
        with np.errstate(over="ignore"):
            return mix((self._sum[size:] - self._sum[:-size]) * self._back[: len(self._sum) - size] + _U(size))

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._sum[ends] - self._sum[starts]) * self._back[starts] + (ends - starts).astype(_U))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of ``column`` as one byte array with the offset of each; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES):
    """``batch, data, offsets`` for consecutive slices of about ``size`` bytes of text and at most
    ``SLICE_ROWS`` rows, whole rows each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        row = 0
        while row < batch.num_rows:
            stop = min(max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1), row + SLICE_ROWS)
            yield (
                batch.slice(row, stop - row),
                data[offsets[row] : offsets[stop]],
                offsets[row : stop + 1] - offsets[row],
            )
            row = stop


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, document`` of every word: runs of word bytes that do not cross a text's end."""
    inside = WORD_BYTE[data]
    n = len(data)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words with A-Z read as a-z."""
    return SpanHash(LOWER_CODES[data])(starts, ends)


def hash_words(items: list[str]) -> np.ndarray:
    """The same hashes for single words."""
    data, offsets = text_bytes(pa.array(items, pa.large_string()))
    return word_hashes(data, offsets[:-1], offsets[1:])


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + length - 1`` of all pairs, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)


def long_column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """An integer column without nulls as int64."""
    return np.asarray(batch.column(batch.schema.get_field_index(name)).cast(pa.int64()))
