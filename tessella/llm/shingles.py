"""Word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

CACHE = 300_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


class Shingler(dict):
    """Hashes words once (bounded memory) and combines them to shingles of ``k`` words.

    A shingle's hash weighs the hashes of its words by position, so it stands
    for the word sequence but for collisions of 64-bit hashes within a pair of
    documents.
    """

    def __init__(self, k: int = 5):
        super().__init__()
        self.k = k
        self.weights = mix(np.arange(1, k + 1, dtype=np.uint64) * _ODD[0]) | np.uint64(1)

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= CACHE:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h

    def of(self, text: str | None) -> np.ndarray:
        """The distinct shingles; a text of fewer words is one shingle, one without words none."""
        words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, n)
        if n < self.k:
            return mix((h * self.weights[:n]).sum(keepdims=True, dtype=np.uint64), n)
        m = n - self.k + 1
        acc = h[:m] * self.weights[0]
        for j in range(1, self.k):
            acc += h[j : j + m] * self.weights[j]
        return np.unique(mix(acc))


def fingerprint(shingles: np.ndarray) -> bytes:
    """16 bytes that stand for the set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
