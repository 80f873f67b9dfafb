"""Word shingles as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers (from splitmix64) that mix words into shingles.
MIX1, MIX2, STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words between white space, A-Z taken as a-z."""
    words = text.encode(errors="replace").lower().split()  # of bytes: ASCII letters and white space only
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the shingles of ``size`` words; of a shorter text, that of all its words."""
    words = word_hashes(text or "")
    n = min(len(words), size)
    if not n:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
        for i in range(n):
            h = mixed(h * STEP + words[i : i + len(h)])
    return np.unique(h)
