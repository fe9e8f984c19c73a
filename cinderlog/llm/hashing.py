"""Hashes of words and byte strings, over whole Arrow batches at once.

A text is hashed with a polynomial over random 64-bit values of its bytes,
modulo 2**64; differences of one running sum give the hash of any stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Grows tables of BASE**i and BASE**-i as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = powers(BASE, size), powers(INVERSE, size)
        return self.up, self.down


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a finaliser of multiply and shift steps)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def running(data: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """Running sums; those at b minus those at a, times BASE**-a, hash data[a:b]."""
    up, _ = POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = POWERS.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def batches(source: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.Table]:
    """Batches joined or cut so that each has about ``limit`` bytes of ``text``, one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in source:
        ends = np.cumsum(np.diff(_offsets(batch.column(text))))
        begin = 0
        while begin < len(ends):
            room = (ends[begin - 1] if begin else 0) + limit - size
            stop = max(int(np.searchsorted(ends, room, "right")), begin + (not held))
            if stop > begin:
                held.append(batch.slice(begin, stop - begin))
                size += int(ends[stop - 1] - (ends[begin - 1] if begin else 0))
            if stop < len(ends) or size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            begin = stop
    if held:
        yield pa.Table.from_batches(held)


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    raw = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1]


def flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and each row's begin, with the end at last."""
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = _offsets(column).astype(np.int64)
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, rows: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all rows, A-Z lower-cased if ``fold``.

    Returns the hashes and, for each row, where its words begin, with the end at last.
    """
    solid = ~IS_BLANK[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = rows[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = running(data, FOLDED_VALUES if fold else BYTE_VALUES)
    return stretch(sums, start, end), np.searchsorted(start, rows)


def windows(values: np.ndarray, begins: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` values within one row, and the row of each."""
    lengths = np.maximum(np.diff(begins) - n + 1, 0)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = begins[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    total = np.zeros(len(at), np.uint64)
    for j in range(n):
        total = total * BASE + values[at + j]
    return mix(total), row
