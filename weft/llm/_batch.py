"""Vectorised text work on Arrow batches.

Strings are taken as the UTF-8 buffers Arrow already holds, many documents at a time, so no
Python string is made per document. Slices are bounded in bytes (one longer document makes a
slice of its own), which bounds the memory of every operator that uses them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Odd multiplier of the polynomial hash, and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


def give_back() -> None:
    """Return what freed arrays held to the system.

    Python workers are kept for later tasks; without this the C library keeps the pages of each
    worker's busiest moment, and a chain of stages adds them up.
    """
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM: Callable[[int], int] | None = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None


def tidy(run: Callable) -> Callable:
    """A function for mapInArrow that gives its memory back at the end of each partition."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    data, off = text_buffers(col)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set between each pair of offsets."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Powers:
    """Powers of the hash multiplier, grown on demand and kept by the worker."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) <= n:
            size = max(n + 1, SLICE_BYTES + 4096)
            up, down = np.full(size, _P, np.uint64), np.full(size, _PINV, np.uint64)
            up[0] = down[0] = 1
            up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
            if size > (16 << 20):
                return up, down
            cls.up, cls.down = up, down
        return cls.up, cls.down


def segment_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal ranges hash alike wherever they stand."""
    n = len(data)
    up, down = Powers.upto(n)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=c[1:])
    h = (c[end] - c[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def is_word_bytes(data: np.ndarray) -> np.ndarray:
    """True where a byte is not ASCII white space (0x20, 0x09-0x0D)."""
    return _WORD[data]


_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def words(data: np.ndarray, off: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets per document) of runs of ``word`` bytes; none crosses documents."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    prev = np.zeros(n, bool)
    prev[1:] = word[:-1]
    prev &= ~edge[:n]
    nxt = np.zeros(n, bool)
    nxt[:-1] = word[1:]
    nxt &= ~edge[1:]
    start = np.flatnonzero(word & ~prev)
    end = np.flatnonzero(word & ~nxt) + 1
    return start, end, np.searchsorted(start, off)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbouring values (length len(h) - n + 1)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for i in range(1, n):
        out = out * np.uint64(_P) + h[i : i + m]
        out ^= out >> np.uint64(29)
    return mix(out)


def window_owner(woff: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(window index, document) of the windows of n words that lie inside one document."""
    count = np.maximum(np.diff(woff) - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    base = np.cumsum(count) - count
    return np.arange(len(doc)) - base[doc] + woff[:-1][doc], doc


def doc_bytes(data: np.ndarray, off: np.ndarray) -> Iterator[bytes]:
    whole = data.tobytes()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield whole[a:b]
