"""Words and hashes of whole Arrow batches of texts, without a Python object per word.

Texts are handled as one flat byte array per chunk. A word's hash is a difference of prefix sums
of ``table[byte] * base ** position`` (mod 2**64), shifted back to position 0 and mixed, so equal
words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 1 << 17

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finaliser of splitmix64); one to one."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def _grown(name: str, base: int, n: int) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        steps = np.full(max(n, 1 << 16), base, U64)
        steps[0] = 1
        _powers[name] = known = np.multiply.accumulate(steps)
    return known[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins (n + 1 numbers); null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row number, bytes and offsets of runs of whole texts; a run has ``size`` bytes or one text."""
    data, offsets = flat(column)
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, row + CHUNK_ROWS)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes outside ``gap``; no run crosses the end of a text."""
    inside = ~gap[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    edge = offsets[:-1][offsets[:-1] < len(data)]
    first = inside & ~before[:-1]
    first[edge] |= inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] |= inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    n = len(data)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_TABLE[data] * _grown("up", _BASE, n), out=sums[1:])
    down = _grown("down", pow(_BASE, -1, 1 << 64), n)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64)) if n else sums[:0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of white-space separated text, and its text's number."""
    starts, ends = spans(data, offsets)
    texts = np.searchsorted(offsets, starts, "right") - 1
    return hashes(data, starts, ends), starts, ends, texts


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` of all i, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in the order they are met, where each is first met, and the number of each value among them."""
    number, found = pd.factorize(values)
    first = np.zeros(len(found), np.int64)
    first[number[::-1]] = np.arange(len(values) - 1, -1, -1)
    return np.asarray(found), first, number


class Memory:
    """Arrays remembered by a 64-bit key, ``most`` of them with ``room`` values, as sorted keys and one array of all values."""

    def __init__(self, dtype: type, most: int = 1 << 19, room: int = 1 << 22):
        self.dtype, self.most, self.room = dtype, most, room
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, U64)
        self.starts, self.sizes = np.zeros((2, 0), np.int64)
        self.store = np.zeros(0, self.dtype)

    def lookup(self, keys: np.ndarray, make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and size of each key's values, and the array they lie in; ``make(places)`` gives the sizes and values of new keys."""
        if len(self.keys) > self.most or len(self.store) > self.room:
            self.clear()
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        fresh = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(fresh):
            sizes, values = make(fresh)
            starts = len(self.store) + np.cumsum(sizes) - sizes
            self.store = np.concatenate([self.store, values])
            order = np.argsort(joined := np.append(self.keys, keys[fresh]), kind="stable")
            self.keys = joined[order]
            self.starts = np.append(self.starts, starts)[order]
            self.sizes = np.append(self.sizes, sizes)[order]
            at = np.searchsorted(self.keys, keys)
        return self.starts[at], self.sizes[at], self.store
