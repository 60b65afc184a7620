"""Numpy kernels over the bytes of Arrow string columns: words, word hashes, hashes of runs of words.

Hashes are 64-bit: a polynomial over the bytes of a word, then over the words of a run, each mixed.
"""

from __future__ import annotations

import ctypes
import platform

import numpy as np
import pyarrow as pa

#: In a Python worker, which lives across tasks, large arrays go back to the system when they are freed.
_LIBC = ctypes.CDLL("libc.so.6") if platform.libc_ver()[0] == "glibc" else None
if _LIBC is not None:
    _LIBC.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD

_RNG = np.random.default_rng(1729)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def tidy() -> None:
    """Returns what is free to the system, at the end of a task's or group's work."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of len + 1) of a string or binary column; null is empty."""
    if column.type in (pa.string(), pa.large_string()):
        column = column.cast(pa.binary() if column.type == pa.string() else pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    wide = column.type == pa.large_binary()
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, len(column) + 1, offset=column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    values = column.buffers()[2] if len(column) else None
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each, at least a row."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1))
        out.append((first, last))
        first = last
    return out


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i below n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            tables = []
            for b in (base, pow(base, -1, 1 << 64)):
                t = np.full(size, np.uint64(b))
                t[0] = 1
                tables.append(np.multiply.accumulate(t))
        have = _POWERS[base] = (tables[0], tables[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total): runs without white space, never across rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:n]
    end[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    power, inverse = _powers(_BASE, len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data] if lower else data] * power[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * inverse[starts])


def run_hashes(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` neighbours: len - k + 1 of them."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    base = (_BASE * (2 * seed + 3)) & (2**64 - 1) | 1
    power, inverse = _powers(base, len(hashes) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes + np.uint64(seed)) * power[: len(hashes)], out=total[1:])
        return mix((total[k:] - total[:-k]) * inverse[: len(hashes) - k + 1] + np.uint64(k))
