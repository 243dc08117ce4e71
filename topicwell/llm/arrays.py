"""Vectorised work on the bytes of Arrow text columns.

A hash of a slice is a polynomial over 64-bit words: with prefix sums of ``value[j] * BASE**-j``
the hash of any slice is one subtraction and one multiplication, and it depends on the slice's
content alone. ``mix`` spreads it over all bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK = 1 << 19

_BYTE_VALUES = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**j`` and ``BASE**-j`` for ``j`` up to ``n``."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for i, base in enumerate((BASE, INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums for ``slices``; one longer than ``values``."""
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * powers(len(values))[1][: len(values)], out=out[1:])
    return out


def slices(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the slices ``starts[i]:ends[i]``."""
    up = powers(len(sums))[0]
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * up[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


def grams(sums: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all slices of ``k`` values."""
    n = len(sums) - k
    if n <= 0:
        return np.empty(0, np.uint64)
    return mix((sums[k:] - sums[:-k]) * powers(len(sums))[0][:n])


def sliding(pick: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """``np.minimum`` or ``np.maximum`` of every window of ``width`` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def byte_values(buffer: np.ndarray) -> np.ndarray:
    return _BYTE_VALUES[buffer]


def column_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    buffer = np.empty(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return buffer, bounds.astype(np.int64)


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``size`` bytes: first row, bytes, and bounds from 0. A row is never cut."""
    buffer, bounds = column_buffer(column)
    row, rows = 0, len(bounds) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, "right")) - 1)
        yield row, buffer[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def words(buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per row, the range of its words."""
    inside = ~_SPACE[buffer]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    begin[first] = inside[first]
    last = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    finish[last] = inside[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_values(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word."""
    return slices(prefix(byte_values(buffer)), starts, ends)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(starts[i], starts[i] + lengths[i])``."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges, in order; ranges that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    return starts[new], reach[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(reach) - 1]))]
