"""64-bit hashes of words and of windows of words."""

from __future__ import annotations

import numpy as np
import xxhash

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


KNOWN = 200_000


class Words(dict):
    """Hashes of words, remembered; emptied at ``KNOWN`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = Words()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    return x ^ (x >> np.uint64(29))


def windows(w: np.ndarray, starts: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``size`` words from each start."""
    h = np.full(len(starts), size + (seed << 8), np.uint64)
    for i in range(size):
        h = mixed(h * M1 + w[starts + i] + M3)
    return h
