"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a Python worker keeps.
KEPT_WORDS = 100_000
MIXERS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A permutation of 64-bit numbers that leaves no trace of their order."""
    x = values + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * MIXERS[0]
    x = (x ^ (x >> np.uint64(27))) * MIXERS[1]
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Hashes of words, worked out once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


KNOWN = Words()


def shingles(text: str, size: int) -> np.ndarray:
    """The distinct shingles of a text, in ascending order of their hash.

    Case of A-Z is ignored; words end at ASCII white space. A text with fewer words
    than a shingle has is one shingle of all its words.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    hashes = np.fromiter(map(KNOWN.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(size, len(hashes))
    if not n:
        return hashes
    found = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        found = (found + hashes[i : len(hashes) - n + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
        found ^= found >> np.uint64(32)
    return np.unique(mixed(found))
