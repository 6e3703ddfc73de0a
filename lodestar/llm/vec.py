"""Vectorised word and shingle hashing over Arrow string batches.

Everything here works on one block of texts at a time (a contiguous byte
buffer plus offsets), so the memory a task needs is set by the block size and
by its single longest text, never by the number of rows.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that separate words: the class [\x20\x09-\x0D].
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
BLOCK_BYTES = 1 << 19

_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: For comparisons across punctuation: ASCII letters, digits and all bytes above 127 stand in words.
PLAIN_WORD = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_powers: dict[str, np.ndarray] = {}


def _table(name: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        steps = np.full(size, base, U64)
        steps[0] = 1
        _powers[name] = have = np.multiply.accumulate(steps)
    return have[:n]


def tidy() -> None:
    """Give memory that a task no longer needs back to the system; worker processes outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) for runs of rows of about `limit` bytes; a null text counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        lo = offsets[row]
        yield row, end, raw[lo : offsets[end]], offsets[row : end + 1] - lo
        row = end


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes in lower case: A-Z, and the capitals of U+00C0 to U+00DE."""
    low = _LOWER[data]
    if len(data) > 1:
        second = data[1:]
        low[1:] += ((data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)).astype(np.uint8) * np.uint8(32)
    return low


def words(data: np.ndarray, offsets: np.ndarray, is_word_byte: np.ndarray = _IS_WORD, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, word offsets by row) of all words of a block."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    is_word = is_word_byte[data]
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    sums = np.zeros(n + 1, U64)
    np.cumsum((folded(data) if fold else _LOWER[data]).astype(U64) * _table("base", _BASE, n) + _table("base", _BASE, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _table("inverse", _INVERSE, n)[starts]
    h = mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
    return h, starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


def shingles(h: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets by row) of all runs of `size` words; a row with fewer words, but at least one, has its whole sequence as its only shingle."""
    n_words = np.diff(at)
    count = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    to = np.zeros(len(at), np.int64)
    np.cumsum(count, out=to[1:])
    if not to[-1]:
        return np.zeros(0, U64), to
    padded = np.concatenate([h, np.zeros(size, U64)])
    first = np.arange(to[-1]) + np.repeat(at[:-1] - to[:-1], count)
    length = np.minimum(np.repeat(n_words, count), size)
    out = length.astype(U64) * U64(0xA0761D6478BD642F)
    short = bool((length < size).any())
    for j in range(size):
        part = padded[first + j] * U64(pow(0xE7037ED1A0B428DB, j + 1, 1 << 64))
        out += np.where(j < length, part, U64(0)) if short else part
    return mix(out), to


def distinct_sorted(h: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each row, and their offsets."""
    h = h.copy()
    for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True):
        if b - a > 1:
            h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[to[:-1][to[:-1] < len(h)]] = True
    kept = np.zeros(len(h) + 1, np.int64)
    np.cumsum(fresh, out=kept[1:])
    return h[fresh], kept[to]


def set_hash(h: np.ndarray, to: np.ndarray) -> np.ndarray:
    """One order-free hash for the values of each row, 0 for an empty row."""
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(mix(h ^ U64(0x2545F4914F6CDD1D)), out=sums[1:])
    n = np.diff(to)
    return np.where(n > 0, mix(sums[to[1:]] - sums[to[:-1]] + n.astype(U64) * U64(0x9FB21C651E98DF25)), U64(0))
