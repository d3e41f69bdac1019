"""Words of whole Arrow batches at once: positions, 64-bit hashes and rolling n-gram hashes in numpy.

A word's hash is a polynomial over its bytes, taken from one running sum over the
batch, so the cost is a few array passes per byte and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C13
BASE_INV = pow(BASE, -1, 1 << 64)
GRAM = np.uint64(0xD6E8FEB86659FD93)
#: The ASCII white space that parts words.
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)

_letters = np.random.RandomState(20240229).randint(0, 1 << 62, 512, dtype=np.int64).astype(np.uint64)
LETTERS = (_letters[:256] << np.uint64(2)) ^ _letters[256:]


def space_separators() -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(SPACES)] = True
    return table


def symbol_separators() -> np.ndarray:
    """All ASCII but letters and digits parts words; bytes beyond ASCII belong to words."""
    table = np.ones(256, bool)
    table[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
    return table


def letters(lower: bool = False) -> np.ndarray:
    table = LETTERS.copy()
    if lower:
        table[65:91] = table[97:123]
    return table


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < max(1, n):
        size = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", BASE_INV)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.cumprod(row, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(NamedTuple):
    start: np.ndarray  # byte positions in data
    end: np.ndarray
    hash: np.ndarray
    doc: np.ndarray  # row of the slice
    first: np.ndarray  # of each row, its first word; one more than rows


class Slice(NamedTuple):
    lo: int
    hi: int
    data: np.ndarray
    bounds: np.ndarray


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[Slice]:
    """Consecutive rows of at most ``limit`` bytes together (a longer row stands alone); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, raw = column.buffers()
    at = np.frombuffer(at, wide)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield Slice(lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray, table: np.ndarray) -> Words:
    n = len(data)
    inside = ~separators[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    cuts = bounds[:-1]
    before[cuts[cuts < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = bounds[1:]
    after[ends[ends > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(table[data] * up, out=total[1:])
    h = mix((total[end] - total[start]) * down[start] if n else np.zeros(0, np.uint64))
    first = np.searchsorted(start, bounds, "left")
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    return Words(start, end, h, doc, first)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive entries; the last n - 1 places have none."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out *= GRAM
        out += h[k : k + size]
    return mix(out)


def within(doc: np.ndarray, n: int) -> np.ndarray:
    """Whether each n-gram lies in one row."""
    size = max(0, len(doc) - n + 1)
    return doc[:size] == doc[n - 1 : n - 1 + size]


def longs(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list column from flat values and row sizes."""
    at = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
