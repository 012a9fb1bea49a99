"""Nucleotide strings as numbers: 2-bit codes, k-mers in 64-bit words, super-k-mers.

Everything works on the flat bytes of an Arrow column, so no Python code runs per base.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Longest k-mer that fits a number.
LONGEST = 31
OTHER = 255  # code of a byte that is not A, C, G or T


def code_table() -> np.ndarray:
    """2-bit code of each byte: A, C, G, T in this order, so numbers sort like the strings."""
    table = np.full(256, OTHER, np.uint8)
    table[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)
    return table


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; a null row is empty."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind).fill_null(b"" if kind == pa.large_binary() else "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(codes: np.ndarray, k: int) -> np.ndarray:
    """The number of every ``k`` consecutive codes, put together from runs of 1, 2, 4, ... codes.

    Up to 16 codes take 32 bits, which halves the memory that is gone through.
    """
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    run, size = codes.astype(np.uint8), 1
    out, done = None, 0
    while True:
        if k & size:
            part = run[done : done + n]
            done += size
            kind = np.uint32 if done <= 16 else np.uint64
            out = part.astype(kind) if out is None else (out.astype(kind, copy=False) << kind(2 * size)) | part
        if done == k:
            return out.astype(np.uint64, copy=False)
        kind = np.uint8 if size <= 2 else np.uint32 if size <= 8 else np.uint64
        run = (run[:-size].astype(kind, copy=False) << kind(2 * size)) | run[size:]
        size *= 2


def reversed_words(codes: np.ndarray, k: int) -> np.ndarray:
    """The number of the reverse complement of every ``k`` consecutive codes."""
    return words((3 - codes)[::-1], k)[::-1]


def canonical_words(codes: np.ndarray, k: int, canonical: bool = True) -> np.ndarray:
    own = words(codes, k)
    return np.minimum(own, reversed_words(codes, k)) if canonical else own


def within(offsets: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Whether the ``k`` codes from each position lie in one row and are all valid."""
    n = len(valid) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    wrong = np.zeros(len(valid) + 1, np.int64)
    np.cumsum(~valid, out=wrong[1:])
    ok = wrong[k:] == wrong[:n]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return ok & (row[:n] == row[k - 1 :])


def smallest_before(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    size = 1
    run = values
    while 2 * size <= width:
        run = np.minimum(run[:-size], run[size:])
        size *= 2
    return np.minimum(run[:n], run[width - size : width - size + n])


def scattered(numbers: np.ndarray) -> np.ndarray:
    """Spread numbers over 64 bits, so that runs of one base are not always the smallest."""
    numbers = (numbers + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return numbers ^ (numbers >> np.uint64(29))


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... counts[0]-1, 0, 1, ... counts[1]-1, and so on."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def super_kmers(codes: np.ndarray, offsets: np.ndarray, k: int, m: int, canonical: bool):
    """Starts, lengths (in bases) and minimisers of the runs of k-mers that share a minimiser."""
    ok = within(offsets, codes != OTHER, k)
    if not ok.any():
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    safe = np.where(codes == OTHER, 0, codes)
    least = smallest_before(scattered(canonical_words(safe, m, canonical)), k - m + 1)
    at = np.flatnonzero(ok)
    least = least[at]
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1])]
    row = np.searchsorted(offsets, at, "right")
    new[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(new)
    lengths = np.diff(np.r_[first, len(at)]) + k - 1
    return at[first], lengths, least[first]


def pack(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Four bases a byte, each run from a byte of its own, and the bytes of each run."""
    sizes = -(-lengths // 4)
    ahead = np.r_[codes, np.zeros(3, np.uint8)].astype(np.uint8) & 3
    four = (ahead[:-3] << 6) | (ahead[1:-2] << 4) | (ahead[2:-1] << 2) | ahead[3:]
    out = four[np.repeat(starts, sizes) + 4 * spread(sizes)]
    # the last byte of a run has what is left of it
    out[np.cumsum(sizes) - 1] &= np.array([0xFF, 0xC0, 0xF0, 0xFC], np.uint8)[lengths % 4]
    return out, sizes


def unpack(packed: np.ndarray) -> np.ndarray:
    """The codes of packed bytes, four for each."""
    return np.stack([(packed >> s) & 3 for s in (6, 4, 2, 0)], axis=1).ravel()


def spelled(numbers: np.ndarray, k: int) -> pa.Array:
    """The strings of k-mer numbers."""
    n = -(-k // 4)  # four letters at a time, the first ones of which may be too many
    four = np.frombuffer(b"ACGT", np.uint8)[(np.arange(256)[:, None] >> np.array([6, 4, 2, 0])) & 3].view(np.uint32).ravel()
    letters = np.empty((len(numbers), n), np.uint32)
    for j in range(n):
        letters[:, j] = four[((numbers >> np.uint64(8 * (n - 1 - j))) & np.uint64(255)).astype(np.uint8)]
    letters = np.ascontiguousarray(letters.view(np.uint8)[:, 4 * n - k :])
    offsets = np.arange(0, k * len(numbers) + 1, k, dtype=np.int32)
    return pa.StringArray.from_buffers(len(numbers), pa.py_buffer(offsets), pa.py_buffer(letters))


def pieces(data: np.ndarray, offsets: np.ndarray, k: int, size: int = 1 << 20):
    """The rows in pieces of ``size`` k-mer starts: where a piece begins, its bytes, and the offsets cut to it.

    Pieces overlap by ``k - 1`` bytes, so every k-mer starts in one of them, however long a row is.
    """
    for begin in range(0, len(data), size):
        own = data[begin : begin + size + k - 1]
        yield begin, own, np.clip(offsets - begin, 0, len(own))


def _plane_places(sizes: np.ndarray, width: int) -> np.ndarray:
    """Where the bytes of each number lie if the first bytes of a group's numbers come first, then the second ones, and so on."""
    begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return (width * begin + spread(sizes))[:, None] + np.arange(width) * np.repeat(sizes, sizes)[:, None]


def planes(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of numbers in groups of ``sizes``, those of one weight side by side.

    The upper bytes of small or similar numbers are runs that the codec of a shuffle shrinks to nothing.
    """
    width = numbers.itemsize
    out = np.empty(width * len(numbers), np.uint8)
    out[_plane_places(sizes, width)] = np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, width)
    return out


def from_planes(data: bytes, sizes: np.ndarray, kind) -> np.ndarray:
    """The numbers of :func:`planes`."""
    width = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8)[_plane_places(np.asarray(sizes), width)].view(kind).ravel()


def cut_up(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of the bytes between bounds."""
    buffers = [None, pa.py_buffer(np.asarray(bounds, np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, buffers)


def gathered(batches, column: int, size: int = 1 << 22, rows: int = 1 << 18):
    """Batches put together until a string column has ``size`` bytes, or they have so many rows."""
    held, held_bytes, held_rows = [], 0, 0
    for batch in batches:
        held.append(batch)
        held_bytes += flat(batch.column(column))[0].size
        held_rows += batch.num_rows
        if held_bytes >= size or held_rows >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
            held, held_bytes, held_rows = [], 0, 0
    if held_rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def bundle(column: pa.Array, bounds: np.ndarray) -> list[pa.Array]:
    """Integers, booleans or strings as two binary columns, a row for each group between bounds; :func:`unbundle` opens them."""
    sizes = np.diff(bounds)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_string(column.type):
        data, offsets = flat(column)
        lengths = (np.diff(offsets) + valid).astype(np.uint32)  # 0 is null
        return [cut_up(planes(lengths, sizes), 4 * bounds), cut_up(data, offsets[bounds])]
    numbers = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    return [cut_up(planes(numbers, sizes), 8 * bounds), cut_up(valid.astype(np.uint8), bounds)]


def unbundle(first: pa.ChunkedArray, second: pa.ChunkedArray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The values of all groups of a column of :func:`bundle`, one after the other."""
    first, second = b"".join(first.to_pylist()), b"".join(second.to_pylist())
    if pa.types.is_string(kind):
        lengths = from_planes(first, sizes, np.uint32).astype(np.int64)
        ends = np.r_[0, np.cumsum(np.maximum(lengths - 1, 0))]
        large = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(second))
        return (large if (lengths > 0).all() else pa.array(large.to_pylist(), pa.large_string(), mask=lengths == 0)).cast(kind)
    numbers = from_planes(first, sizes, np.int64)
    return pa.array(numbers, mask=np.frombuffer(second, np.uint8) == 0).cast(kind)


def bundles(kinds) -> bool:
    """Whether values of all these Arrow types can be bundled."""
    return all(pa.types.is_integer(t) or pa.types.is_boolean(t) or pa.types.is_string(t) for t in kinds)


def shrunk(texts: pa.Array) -> pa.Array:
    """Each sequence in two bits a base behind a byte with the bases of its last byte; others as they are behind a 255."""
    data, offsets = flat(texts)
    table = code_table()[data]
    lengths = np.diff(offsets)
    wrong = np.r_[0, np.cumsum(table == OTHER)]
    clean = wrong[offsets[1:]] == wrong[offsets[:-1]]
    some = np.flatnonzero(clean & (lengths > 0))
    packed = pack(np.where(table == OTHER, 0, table), offsets[some], lengths[some])[0] if len(some) else data[:0]
    out_sizes = 1 + np.where(clean, -(-lengths // 4), lengths)
    ends = np.r_[0, np.cumsum(out_sizes)]
    out = np.empty(int(ends[-1]), np.uint8)
    head = np.zeros(len(out), bool)
    head[ends[:-1]] = True
    out[head] = np.where(clean, lengths % 4, 255)
    body, tidy = ~head, np.repeat(clean, out_sizes)
    out[body & tidy] = packed
    out[body & ~tidy] = data[np.repeat(~clean, lengths)]
    made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(out)]).cast(pa.binary())
    return made if not texts.null_count else pa.array(made.to_pylist(), pa.binary(), mask=texts.is_null().to_numpy(zero_copy_only=False))


def restored(packed: pa.Array) -> pa.Array:
    """The sequences of :func:`shrunk`."""
    data, offsets = flat(packed)
    sizes = np.diff(offsets)
    there = sizes > 0
    kind = np.full(len(sizes), 255, np.int64)
    kind[there] = data[offsets[:-1][there]]
    clean = there & (kind < 4)
    lengths = np.where(clean, 4 * (sizes - 1) - (4 - kind) % 4 * (sizes > 1), np.maximum(sizes - 1, 0))
    ends = np.r_[0, np.cumsum(lengths)]
    out = np.empty(int(ends[-1]), np.uint8)
    body = np.ones(len(data), bool)
    body[offsets[:-1][there]] = False
    tidy = np.repeat(clean, sizes)
    letters = np.frombuffer(b"ACGT", np.uint8)[unpack(data[body & tidy])]
    own = np.where(clean, sizes - 1, 0)
    keep = np.ones(len(letters), bool)
    short = np.flatnonzero(clean & (4 * own > lengths))
    for cut in range(1, 4):  # bases of the last byte that are none
        last = 4 * np.cumsum(own)[short[4 * own[short] - lengths[short] >= cut]] - cut
        keep[last] = False
    of_clean = np.repeat(clean, lengths)
    out[of_clean] = letters[keep]
    out[~of_clean] = data[body & ~tidy]
    made = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(out)).cast(pa.string())
    return made if not packed.null_count else pa.array(made.to_pylist(), pa.string(), mask=packed.is_null().to_numpy(zero_copy_only=False))
