"""Vectorised byte and word hashing over Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D. UTF-8 never uses those bytes inside a
longer character, so working on bytes gives the same words as working on code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
_GOLD, _M1, _M2 = U64(0xD1342543DE82EF95), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
SLAB = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x *= _M1
    x ^= x >> U64(27)
    x *= _M2
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLAB + 65536)
        have = np.full(size, base % (1 << 64), U64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=U64)
    return have[:n]


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slabs(offs: np.ndarray, limit: int = SLAB):
    """Row ranges (from, to) of about `limit` bytes each; a longer row stands alone."""
    n, at = len(offs) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which `span_hash` takes the hash of any span."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes start..end-1 that doesn't depend on where they stand."""
    inverse = powers(pow(BASE, -1, 1 << 64), len(sums))
    raw = (sums[end] - sums[start]) * inverse[start]
    return mix(raw + (end - start).astype(U64) * _GOLD)


def window_hash(sums: np.ndarray, width: int) -> np.ndarray:
    """span_hash of each span of `width` bytes."""
    inverse = powers(pow(BASE, -1, 1 << 64), len(sums))
    m = len(sums) - width
    return mix((sums[width:] - sums[:m]) * inverse[:m] + U64(width * int(_GOLD) % (1 << 64)))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words never cross rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~WHITE[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = False
    edge[offs] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def combine(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hash of its beginning and of the next element."""
    return mix(first * _GOLD + then)


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of all n-word sequences that lie in one row."""
    if len(hashes) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    m = len(hashes) - n + 1
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    out = hashes[at]
    for j in range(1, n):
        out = combine(out, hashes[at + j])
    return out, at


def code_points(data: np.ndarray) -> np.ndarray:
    """For each byte offset, the number of code points before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
