"""Numpy kernels over the UTF-8 bytes of many texts at once.

A text batch is (raw, off): all bytes, and len(texts) + 1 offsets.  Words are maximal runs of
bytes other than space and \\x09-\\x0D, as in the pattern [^\\x20\\x09-\\x0D]+; UTF-8 never has these
bytes inside a longer character.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Odd multiplier of the polynomial hash, and a seeded table that maps each byte to 64 random bits.
BASE = U64(0x9E3779B97F4A7C15)
TABLE = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_POWERS = np.ones(1, U64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of letters and digits: ASCII ones, and all of longer characters.
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(n: int) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1) modulo 2 ** 64."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 4096), BASE, U64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def runs(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of flagged bytes inside a text, and for each text the number
    of runs before it (length + 1)."""
    n = len(flag)
    inside = np.empty(n + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = flag
    starts = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    cut = off[(off > 0) & (off < n)]
    starts[cut] = flag[cut]
    ends[cut - 1] = flag[cut - 1]
    a, b = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return a, b, np.searchsorted(a, off)


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of each text, as of ``runs``."""
    return runs(~IS_SPACE[raw], off)


def terms(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and digits of each text, without regard to the case of A-Z, and
    the number of runs before each text."""
    low = LOWER[raw]
    a, b, first = runs(IS_TERM[low], off)
    return segment_hash(low, a, b), first


def segment_hash(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hash of raw[a[i]:b[i]], the same for equal bytes; segments ascend and don't overlap."""
    if not len(a):
        return np.zeros(0, U64)
    size = b - a
    first = np.zeros(len(a), np.int64)
    np.cumsum(size[:-1], out=first[1:])
    if int(size.sum()) == int(b[-1] - a[0]):
        part = raw[a[0] : b[-1]]
    else:
        part = raw[np.repeat(a - first, size) + np.arange(int(size.sum()))]
    place = np.arange(len(part)) - np.repeat(first, size)
    value = TABLE[part]
    value *= powers(int(size.max()))[place]
    out = np.zeros(len(a), U64)
    some = np.flatnonzero(size)
    out[some] = np.add.reduceat(value, first[some])
    return mix(out ^ (size.astype(U64) * U64(0xD6E8FEB86659FD93)))


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values (len(h) - k + 1 of them), in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out *= U64(0xFF51AFD7ED558CCD)
        out += h[j : j + n]
    return mix(out)


def windows_in_texts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts with items first[i]:first[i + 1]: a mask of the windows of k items that stay inside
    a text, and the text of each window (over all len - k + 1 windows)."""
    n = max(0, int(first[-1]) - k + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    last = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= last, text


def counts(first: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """Sum of flag over first[i]:first[i + 1], for each text."""
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
