"""Vectorised word splitting and 64-bit hashing of Arrow string columns.

A chunk of texts is one byte buffer with offsets. Words are found with boolean
masks and hashed with a prefix polynomial modulo 2**64, so no Python object is
made per word. All helpers take whole texts; a chunk holds whole rows.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 4 << 20
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
BYTE_CODE = np.random.default_rng(1_618_033).integers(1, 1 << 63, 256, dtype=np.uint64)
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
#: Bytes that part words: space and the ASCII controls 9 to 13.
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least."""
    if len(_powers[0]) < n:
        n = 1 << n.bit_length()
        for k, b in enumerate((BASE, BASE_INV)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES, most_rows: int = 1 << 20):
    """Yields (first row, last row + 1, bytes, offsets) of whole rows, about ``limit`` bytes and ``most_rows`` each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, lo + most_rows)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(buf: np.ndarray, offsets: np.ndarray, part: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of bytes that don't part words."""
    inside = ~part[buf]
    n = len(buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[(offsets > 0) & (offsets < n)]
    before[edge], after[edge - 1] = False, False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix(buf: np.ndarray, fold: bool = True) -> np.ndarray:
    """Running polynomial sums of bytes, A-Z lower-cased unless ``fold`` is False; see spans()."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE_CODE[FOLD[buf] if fold else buf] * powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, alike wherever the span lies."""
    inv = powers(len(sums))[1]
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(buf: np.ndarray, offsets: np.ndarray, part: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word, A-Z lower-cased."""
    s, e, row = words(buf, offsets, part)
    return spans(prefix(buf), s, e), row


def release() -> None:
    """Gives freed memory back to the system at a task's end, where the C library can: a worker outlives its task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
