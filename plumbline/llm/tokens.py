"""Whole texts of an Arrow batch as numpy arrays: bytes, words, word hashes. All work is by array."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in slices of so many bytes, or one text; bounds the memory of the arrays.
SLICE_BYTES = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = np.uint64(0x9E3779B97F4A7C15)
_B_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of the two kinds of words: all but white space; letters, digits and everything beyond ASCII (after lower-casing).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int):
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES + 1)
            grow = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))])
            cls.up, cls.down = grow(_B), grow(_B_INV)
        return cls.up, cls.down


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row starts with the end) of consecutive rows; null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = column.type in (pa.large_string(), pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def word_spans(data: np.ndarray, rows: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (with the end)."""
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    full = rows[:-1][rows[:-1] < rows[1:]]
    first[full] = inside[full]
    ends = rows[1:][rows[:-1] < rows[1:]] - 1
    last[ends] = inside[ends]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(starts, rows)


class Hasher:
    """64-bit hashes of any spans of one array of bytes, A-Z lower-cased if fold."""

    def __init__(self, data: np.ndarray, fold: bool = True):
        up, self.down = Powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((_BYTE[LOWER] if fold else _BYTE)[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[stops] - self.sums[starts]) * self.down[starts] + (stops - starts).astype(np.uint64))


def hash_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, fold: bool = True) -> np.ndarray:
    """A hash of each span's bytes."""
    return Hasher(data, fold)(starts, stops)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row number of each word, from the rows' first words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sum_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over each row's words; 0 for a row without words."""
    ends = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return ends[first[1:]] - ends[first[:-1]]
