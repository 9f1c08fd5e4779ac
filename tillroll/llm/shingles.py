"""Sets of hashed word shingles."""

import numpy as np
import xxhash

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Shingler:
    """Words as 64-bit hashes, shingles as 62-bit hashes of ``k`` of them."""

    def __init__(self, k):
        self.k = k

    def words(self, text):
        """64-bit hashes of the words: runs of non-space, ASCII in lower case."""
        words = (text or "").encode().translate(LOWER).split()
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))

    def runs(self, words, k):
        """62-bit hashes of all runs of ``k`` words."""
        n = len(words) - k + 1
        mixed = np.full(n, k, np.uint64)
        for i in range(k):
            mixed = (mixed ^ words[i : i + n]) * _ODD
            mixed ^= mixed >> np.uint64(29)
        mixed = mixed * _MIX
        return (mixed ^ (mixed >> np.uint64(32))) >> np.uint64(2)

    def set_of(self, text):
        """Sorted distinct shingles; of fewer than ``k`` words all as one."""
        words = self.words(text)
        if not len(words):
            return np.zeros(0, np.uint64)
        return np.unique(self.runs(words, min(self.k, len(words))))
