"""Word shingles of a text as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; a chunk ends between two words.
CHUNK = 1 << 20
_rng = np.random.default_rng(20240229)
#: A random odd number for each byte, and the powers of an odd base: a word's hash is the sum of number times power.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, 1 << 14), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each bit over the word (a 64-bit finaliser)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hash_chunk(data: bytes) -> np.ndarray:
    codes = np.frombuffer(data, np.uint8)
    blank = _BLANK[codes]
    edge = np.diff(np.concatenate(([True], blank, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _power(len(codes))
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTE[codes] * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word, in order; words end at blanks, tabs and line ends only."""
    data = text.encode("utf-8", "surrogatepass")
    if len(data) <= CHUNK:
        return _hash_chunk(data)
    parts, start = [], 0
    while start < len(data):
        end = min(start + CHUNK, len(data))
        while end < len(data) and not _BLANK[data[end]]:
            end += 1
        parts.append(_hash_chunk(data[start:end]))
        start = end
    return np.concatenate(parts)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; a shorter text is one run."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(min(size, len(words))):
        runs = mix(runs * np.uint64(3) + words[k:k + n])
    return np.unique(runs)
