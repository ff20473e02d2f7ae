"""Words and word hashes of Arrow text columns, computed with numpy over many texts at once.

Runs inside tasks. Texts are taken in slices of about ``SLICE_BYTES``, so memory depends
on the longest single text and not on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def _table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


# Bytes that end a word, in the two word definitions in use.
WHITE_SPACE = _table(b" \t\n\x0b\x0c\r")
NOT_ALPHANUMERIC = _table(bytes(b for b in range(128) if not chr(b).isalnum()))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> U(31))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


@dataclass
class Texts:
    """A run of rows of a batch: their bytes and where each text begins and ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def bytes_of(self, row: int) -> bytes:
        return self.data[self.offsets[row]:self.offsets[row + 1]].tobytes()


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """Rows of a string column (null counts as empty) in runs of about ``limit`` bytes."""
    column = pc.fill_null(column, "") if column.null_count else column
    if len(column) == 0:
        return
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(ends, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        last = min(max(last, row + 1), len(column))
        own = offsets[row:last + 1]
        yield Texts(row, data[own[0]:own[-1]], own - own[0])
        row = last


class _Powers:
    """Powers of the hash base and of its inverse, kept for the longest slice so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(cls.up):
            size = max(n, min(2 * n, SLICE_BYTES + 1))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(cls, name, np.multiply.accumulate(powers))
        return cls.up, cls.down


@dataclass
class Words:
    """Words of a slice, in order: row, byte range and 64-bit hash of the lower-cased bytes."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of the first word of each row, and the total


def words(texts: Texts, ends: np.ndarray = WHITE_SPACE) -> Words:
    n = len(texts.data)
    inside = ~ends[texts.data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = texts.offsets[(texts.offsets > 0) & (texts.offsets < n)]
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:]
    stops[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = _Powers.get(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[LOWER[texts.data]] * up[:n], out=sums[1:])
    value = mix((sums[end] - sums[start]) * down[start])
    first = np.searchsorted(start, texts.offsets)
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(row, start, end, value, first)


def windows(value: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """Hashes of the values at the given places after each position; the last ones are cut."""
    n = max(len(value) - places[-1], 0)
    total = np.full(n, len(places), np.uint64)
    for k, p in enumerate(places):
        total += value[p:p + n] * U((0xD6E8FEB86659FD93 * (2 * k + 1) + 2 * k) % (1 << 64) | 1)
    return mix(total)
