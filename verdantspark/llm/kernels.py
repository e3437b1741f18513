"""Vectorised kernels over UTF-8 buffers: word boundaries, word hashes, rolling window hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INV = U64(pow(int(_MULT), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}

#: Byte classes.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Digits, ASCII lower-case letters and every byte of a non-ASCII character.
WORDISH = np.zeros(256, bool)
WORDISH[0x30:0x3A] = WORDISH[0x61:0x7B] = WORDISH[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values that spreads every bit."""
    x = x.copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept, and doubled when a longer run is asked for."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        got = np.full(size, base, U64)
        got[0] = 1
        np.cumprod(got, out=got)
        _powers[int(base)] = got
    return got[:n]


def words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in `table` that lie in one row; and where each row's words begin."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[buf]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def gathered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given stretches of bytes as strings."""
    lens = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lens)])
    data = buf[np.arange(offsets[-1]) - np.repeat(offsets[:-1], lens) + np.repeat(starts, lens)]
    return pa.StringArray.from_buffers(len(lens), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes: a mixed polynomial over a random table, so equal words have equal hashes anywhere."""
    if not len(starts):
        return np.zeros(0, U64)
    values = mix(np.arange(256, dtype=U64) + U64(seed * 1000))
    lens = ends - starts
    first = np.concatenate([[0], np.cumsum(lens)])
    at = np.arange(first[-1]) - np.repeat(first[:-1], lens)
    taken = buf[at + np.repeat(starts, lens)]
    h = np.add.reduceat(values[taken] * powers(_MULT, int(lens.max()))[at], first[:-1])
    return mix(h + lens.astype(U64) * U64(0xD6E8FEB86659FD93))


def window_starts(row_words: np.ndarray, k: int) -> np.ndarray:
    """The first words of all runs of k words within a row."""
    counts = np.maximum(np.diff(row_words) - k + 1, 0)
    first = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - np.repeat(first, counts) + np.repeat(row_words[:-1], counts)


def runs_at(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words that begin at the given words."""
    n = len(hashes)
    if not len(at):
        return np.zeros(0, U64)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(hashes * powers(_MULT, n), out=prefix[1:])
    return mix((prefix[at + k] - prefix[at]) * powers(_INV, n)[at])


def window_hashes(hashes: np.ndarray, row_words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a row, and the index of each run's first word."""
    at = window_starts(row_words, k)
    return runs_at(hashes, at, k), at


def covered(flags: np.ndarray, at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in a flagged run of k words that begins at `at`."""
    step = np.zeros(n + 1, np.int64)
    hit = at[flags]
    np.add.at(step, hit, 1)
    np.add.at(step, hit + k, -1)
    return np.cumsum(step[:-1]) > 0
