"""Arrow text columns as flat byte arrays: words, hashes and runs without a Python loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer document is a slice of its own.
SLICE_BYTES = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def not_blank() -> np.ndarray:
    """Byte table of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, bool)
    table[[9, 10, 11, 12, 13, 32]] = False
    return table


def ascii_lower() -> np.ndarray:
    """Byte table that lowers A-Z and nothing else."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(column) == 0 or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of up to ``limit`` bytes; every range has one row at least."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def word_spans(
    data: np.ndarray, offsets: np.ndarray, inside: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of every row.

    ``inside`` tells for each byte whether it belongs to a word; no word crosses rows.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = inside[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begin[cut] = word[cut]
    end[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of a well-known generator)."""
    values = values ^ (values >> np.uint64(30))
    values *= np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


class Hasher:
    """64-bit hashes of byte ranges, from one running sum over the bytes."""

    def __init__(self) -> None:
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, np.uint64)
        if len(self.powers) <= len(data):
            size = max(len(data) + 1, SLICE_BYTES + 1)
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE)])
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _INVERSE)])
        sums = np.zeros(len(data) + 1, np.uint64)
        weighted = self.powers[: len(data)] * (data.astype(np.uint64) + np.uint64(1))
        np.cumsum(weighted, out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * self.inverses[starts])


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive values; shorter by ``size - 1``."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    weight = 1
    for k in range(size):
        total += hashes[k : k + n] * np.uint64(weight)
        weight = weight * 0xD6E8FEB86659FD93 % (1 << 64)
    return mixed(total)


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0]-1, 0, 1, ... counts[1]-1, and so on."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - counts, counts)
