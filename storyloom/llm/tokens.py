"""Whitespace words of Arrow string columns and their 64-bit hashes, computed a batch at a time with numpy.

The helpers work on the byte buffer of a whole Arrow column, so no Python object is made for a word. Work arrays are
bounded by PIECE bytes of text, also inside one very long text; only what is kept per word grows with the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
U64 = np.uint64

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Odd multipliers of the polynomial hashes; one per independent hash.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    return np.cumprod(out, dtype=U64)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its row offsets; nulls become empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(data: np.ndarray, offs: np.ndarray, limit: int = PIECE):
    """Ranges of bytes of about ``limit``, cut at row ends or, inside longer rows, at whitespace."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + limit, n)
        if end < n:
            row_end = offs[np.searchsorted(offs, end, "right") - 1]
            if row_end > at:
                end = int(row_end)
            else:
                row_end = int(offs[np.searchsorted(offs, end, "right")])
                while end < row_end and not SPACE[data[end]]:
                    end += 1
        yield at, end
        at = end


def row_slices(column: pa.Array, limit: int = 4 * PIECE) -> Iterator[pa.Array]:
    """The column in slices of about ``limit`` bytes of text, so that what is kept per word stays small for a batch of
    long texts; a row is never cut."""
    place = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // limit
    edges = np.flatnonzero(np.diff(place)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(column)], strict=True):
        yield column.slice(a, b - a)


@dataclass
class Words:
    """Words of a batch: byte ranges, hashes and, per row, the index of its first word (one entry more than rows)."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: tuple[np.ndarray, ...]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False, hashes: int = 1) -> Words:
    """Maximal runs of bytes other than space and \\x09-\\x0D in every row."""
    starts, ends, hashed = [], [], [[] for _ in range(hashes)]
    for lo, hi in pieces(data, offs):
        part = data[lo:hi]
        inside = ~SPACE[part]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        rows = offs[np.searchsorted(offs, lo) : np.searchsorted(offs, hi)] - lo
        before[rows] = False
        s = np.flatnonzero(inside & ~before)
        if not len(s):
            continue
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        cut = rows[rows > 0] - 1
        after[cut] = False
        e = np.flatnonzero(inside & ~after) + 1
        size = e - s
        begin = np.cumsum(size) - size
        chars = part[inside]
        chars = (LOWER[chars] if lower else chars).astype(U64) + U64(1)
        place = np.arange(len(chars)) - np.repeat(begin, size)
        top = int(size.max())
        for k in range(hashes):
            hashed[k].append(mix(np.add.reduceat(chars * powers(BASES[k], top)[place], begin) + size.astype(U64) * U64(0xD6E8FEB86659FD93)))
        starts.append(s + lo)
        ends.append(e + lo)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    s = join(starts, np.int64)
    return Words(s, join(ends, np.int64), np.searchsorted(s, offs), tuple(join(x, U64) for x in hashed))


def windows(found: Words, size: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows that stay within a row, and the index of each window's first word."""
    h = found.hashes[which]
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(n, U64)
    factor = powers(BASES[1 - which], size)
    for k in range(size):
        out += h[k : k + n] * factor[k]
    inside = np.ones(n, bool)
    for back in range(1, size):
        cut = found.first[1:-1] - back
        inside[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(inside)
    return mix(out[at]), at
