"""Words and word shingles of Arrow text columns as 64-bit hashes, whole batches at a time.

A word is a maximal run of bytes other than ASCII white space; A-Z count as a-z. Word hashes are
differences of a running polynomial sum over the bytes, so no Python object is made for a word. The arrays for that take
some 60 bytes for each byte of text, so texts are read in slices of about SLICE_BYTES: several short rows, or a part of a long
one that ends at white space. What is left of a long text is 8 bytes for each word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_tables: list[np.ndarray] = []

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on from task to task and stage to stage."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """run(batches), with trim() at the end of each partition."""

    @functools.wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return out


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n; tables up to 2 MB of text are kept."""
    if _tables and len(_tables[0]) >= n:
        return _tables[0], _tables[1]
    size = max(n, SLICE_BYTES)
    made = []
    for base in (_BASE, _BASE_INV):
        t = np.full(size, base, _U)
        t[0] = 1
        made.append(np.cumprod(t, dtype=_U))
    if size <= 1 << 21:
        _tables[:] = made
    return made[0], made[1]


class Words(NamedTuple):
    data: np.ndarray  # bytes, A-Z lowered
    row_at: np.ndarray  # where each row's bytes begin, and the end
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray  # where each row's words begin, and the end
    hashes: np.ndarray
    sums: np.ndarray  # running sums with a leading zero, for hashes of any byte range

    def range_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges [a, b)."""
        return mix((self.sums[b] - self.sums[a]) * powers(len(self.data) + 1)[1][a])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column's bytes and row boundaries; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `limit` bytes; a longer row stands alone."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, at: np.ndarray, lower: bool = True) -> Words:
    n = len(data)
    low = LOWER[data] if lower else data
    if not n:
        z = np.zeros(0, np.int64)
        return Words(low, at, z, z, np.zeros(len(at), np.int64), np.zeros(0, _U), np.zeros(1, _U))
    inside = ~WHITE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = at[:-1] < at[1:]
    b, e = at[:-1][full], at[1:][full] - 1
    first[b] = inside[b]
    last[e] = inside[e]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(n + 1, _U)
    np.cumsum((low.astype(_U) + _U(1)) * powers(n + 1)[0][:n], out=sums[1:])
    out = Words(low, at, starts, ends, np.searchsorted(starts, at), np.zeros(0, _U), sums)
    return out._replace(hashes=out.range_hash(starts, ends))


def spread(counts: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each row the indices begin, begin + 1, ..., counts of them, all rows in one array."""
    done = np.cumsum(counts) - counts
    return np.repeat(begin - done, counts) + np.arange(int(counts.sum()))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words, whichever row they are in."""
    n = max(0, len(hashes) - k + 1)
    out = np.full(n, _U(k), _U)
    for j in range(k):
        out = out * _BASE + hashes[j : j + n]
    return mix(out)


def cuts(data: np.ndarray, begin: int, end: int, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about `limit` bytes, one after another, that end at white space or at `end`: no word is in two.

    A word longer than that makes its range longer, which is the only way in which memory grows with a text's form."""
    a = begin
    while a < end:
        b, look = min(a + limit, end), 1 << 16
        while b < end:
            white = np.flatnonzero(WHITE[data[b : b + look]])
            if len(white):
                b += int(white[0])
                break
            b, look = min(b + look, end), look * 2
        yield a, b
        a = b


def hashed(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and where each row's begin. Rows longer than 2 * SLICE_BYTES are read range by range."""
    if len(at) != 2 or at[-1] <= 2 * SLICE_BYTES:
        w = words(data, at)
        return w.hashes, w.ptr
    parts = [words(data[a:b], np.array([0, b - a])).hashes for a, b in cuts(data, 0, int(at[-1]))]
    every = np.concatenate(parts)
    return every, np.array([0, len(every)])


def shingles(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's k-word shingles in order, and where each row's begin. With fewer words: the whole sequence as one; without words: none."""
    count = np.diff(at)
    made = np.maximum(count - k + 1, 0)
    short = np.flatnonzero((count > 0) & (count < k))
    made[short] = 1
    ptr = np.concatenate([[0], np.cumsum(made)])
    every = window_hashes(hashes, k)
    if len(count) == 1 and not len(short):
        return every, ptr
    whole = np.where(count >= k, made, 0)
    out = np.zeros(int(ptr[-1]), _U)
    out[spread(whole, ptr[:-1])] = every[spread(whole, at[:-1])]
    for r in short:
        out[ptr[r]] = window_hashes(hashes[at[r] : at[r + 1]], int(count[r]))[0]
    return out, ptr
