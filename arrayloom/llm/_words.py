"""Vectorised words and rolling hashes over Arrow string columns.

A word's hash is a polynomial over its bytes modulo 2**64, and a window's hash a
polynomial over word hashes, so that any slice costs one subtraction of running
sums.  Chunks are cut by bytes, which bounds memory however long a batch is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Small enough that all arrays over a chunk take a few MB, in every worker.
CHUNK_BYTES = 256 << 10
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}

#: Bytes that are no part of a word: space and the controls from tab to return.
SPACE = np.ones(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The powers 0 to n of the base, or of its inverse, modulo 2**64; kept if short."""
    base = _INVERSE if inverse else _BASE
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 2 * CHUNK_BYTES:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) of slices of about ``most`` bytes.

    Nulls count as empty texts.  A text longer than ``most`` is a slice by itself.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def split(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text where its words begin."""
    n = len(data)
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    if n:
        joins = np.zeros(n, dtype=bool)
        joins[offsets[:-1][offsets[:-1] < n]] = True  # a text begins: no word runs over it
        first[1:] &= ~inside[:-1] | joins[1:]
        last[:-1] &= ~inside[1:] | joins[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * powers(len(data), True)[starts] + (ends - starts).astype(np.uint64))


def sums(words: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`window` takes the hash of any slice of words."""
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * powers(len(words))[: len(words)], out=total[1:])
    return total


def window(total: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of the slices from ``at`` to ``end`` of the words."""
    return mix((total[end] - total[at]) * powers(len(total), True)[at])
