"""Words, word hashes and shingles of whole texts, on bytes and numpy arrays.

A word is a run of anything but space and \\x09-\\x0D, which is what bytes.split() gives.
"""

from __future__ import annotations

import numpy as np
import xxhash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words seen so far; emptied when it has `limit` words."""

    def __init__(self, limit: int = 250_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the 64 bits of the result."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each window of k words, in order."""
    n = len(hashes) - k + 1
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : n + j]
    return mix(out)


def shingle_set(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct shingles as int64; the whole sequence is one where there are fewer than k words."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.int64)
    if n < k:
        return grams(np.r_[hashes, np.full(1, n, np.uint64)], n + 1).view(np.int64)
    return np.unique(grams(hashes, k).view(np.int64))
