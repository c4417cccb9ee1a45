"""Texts of an Arrow column as one byte array, their words, and prefix polynomial hashes over it.

Work goes block by block of bounded bytes, so a task's memory does not follow the size of a batch;
only one very long text by itself can exceed the block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2_000_000

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of texts with about ``limit`` bytes; a missing text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(places, places[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[places[first] : places[last]], places[first : last + 1] - places[first]
        first = last


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and of which text each is (runs of bytes that are no white space)."""
    solid = ~_IS_SPACE[data]
    inner = offsets[1:-1]
    inner = inner[inner < len(data)]
    starting = solid.copy()
    starting[1:] &= ~solid[:-1]
    starting[inner] = solid[inner]
    ending = solid.copy()
    ending[:-1] &= ~solid[1:]
    before = inner[inner > 0] - 1
    ending[before] = solid[before]
    starts, ends = np.flatnonzero(starting), np.flatnonzero(ending) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _grow(n: int) -> None:
    global _POWERS, _INVERSES
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        inverse = pow(BASE, -1, 1 << 64)
        steps = np.full(size, BASE, np.uint64)
        steps[0] = 1
        _POWERS = np.cumprod(steps, dtype=np.uint64)
        steps = np.full(size, inverse, np.uint64)
        steps[0] = 1
        _INVERSES = np.cumprod(steps, dtype=np.uint64)


def inverses(n: int) -> np.ndarray:
    """Powers 0 to n - 1 of the inverse of the base."""
    _grow(n)
    return _INVERSES[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Running sums of byte times power of an odd base, modulo 2^64; entry i covers the first i bytes."""
    _grow(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span, equal for equal bytes wherever they stand."""
    return (prefix[ends] - prefix[starts]) * _INVERSES[starts]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A keyed bijection of 64-bit numbers whose bits all depend on all bits of the input."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word (spans that do not overlap, in order), equal for equal bytes: the sum of one drawn number for
    each byte and place in the word. Unlike a polynomial modulo 2^64 it has no structure that words could share."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    drawn = mixed((place.astype(np.uint64) << np.uint64(8)) | data[place + np.repeat(starts, size)], 3)
    return np.add.reduceat(drawn, first)


def in_batches(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Columns as dicts of arrays, one record batch each; at least an empty one is not needed."""
    for columns in rows:
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
