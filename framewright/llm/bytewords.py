"""Vectorised words of UTF-8 texts: positions and 64-bit hashes, a block of documents at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64

#: Bytes of words between the six ASCII white-space characters.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: ASCII digits, lower-case letters and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.Generator(np.random.PCG64(20240607))
_SYMBOL = _rng.integers(0, 2**64, 256, dtype=U64)
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5  # 5 modulo 8: powers keep apart
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(16, int(n - 1).bit_length()), base, U64)
        have[0] = 1
        have = np.cumprod(have)
        if n <= 1 << 21:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; a new array."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes; a longer row stands alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def spans(raw: np.ndarray, offsets: np.ndarray, of_word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and of each row the index of its first word (one more at the end)."""
    inside = of_word[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(raw))]
    before[cut] = False
    after[cut - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, the same in every process."""
    if not len(starts):
        return np.zeros(0, U64)
    running = np.empty(len(raw) + 1, U64)
    running[0] = 0
    np.cumsum(_SYMBOL[raw] * _power(_BASE, len(raw)), out=running[1:])
    found = (running[ends] - running[starts]) * _power(_INVERSE, len(raw))[starts]
    return mix(found + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(column: pa.Array | pa.ChunkedArray, of_word: np.ndarray = SPACED, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and of each row the index of its first word (one more at the end)."""
    raw, offsets = text_buffers(column)
    found, firsts, base = [], [np.zeros(1, np.int64)], 0
    for lo, hi in blocks(offsets):
        part = raw[offsets[lo] : offsets[hi]]
        part = LOWER[part] if lower else part
        starts, ends, first = spans(part, offsets[lo : hi + 1] - offsets[lo], of_word)
        found.append(hashes(part, starts, ends))
        firsts.append(first[1:] + base)
        base += len(starts)
    return (np.concatenate(found) if found else np.zeros(0, U64)), np.concatenate(firsts)


_LANES = _rng.integers(0, 2**64, (4, 64), dtype=U64) | U64(1)


def windows(h: np.ndarray, n: int, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of every n consecutive word hashes, row borders ignored."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    total = np.zeros(m, U64)
    for j in range(n):
        total += h[j : j + m] * _LANES[lane, j % 64] if n <= 64 else mix(h[j : j + m] + U64(j * 2 + lane))
    return mix(total)


def inner(first: np.ndarray, n: int, width: int) -> np.ndarray:
    """Which of the windows of `width` words over n words lie in one row."""
    ok = np.zeros(max(0, n - width + 1), bool)
    if len(ok):
        edge = np.zeros(len(ok) + 1, np.int32)
        lo, hi = first[:-1], np.maximum(first[1:] - width + 1, first[:-1])
        np.add.at(edge, np.minimum(lo, len(ok)), 1)
        np.add.at(edge, np.minimum(hi, len(ok)), -1)
        ok = np.cumsum(edge[:-1]) > 0
    return ok


def pack(x: np.ndarray) -> bytes:
    """Ascending whole numbers under 2**32 as 16- or 32-bit steps."""
    steps = np.diff(x.astype(np.int64), prepend=0)
    return b"\2" + steps.astype(np.uint16).tobytes() if not len(steps) or steps.max() < 65536 else b"\4" + steps.astype(np.uint32).tobytes()


def unpack(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, np.uint16 if x[0] == 2 else np.uint32, offset=1), dtype=np.int64)


def slices(ordered: np.ndarray, n: int) -> np.ndarray:
    """Where each of 0..n-1 begins in ascending whole numbers, and the end."""
    return np.searchsorted(ordered, np.arange(n + 1, dtype=ordered.dtype))
