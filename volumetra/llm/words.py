"""Words of whole texts as 64-bit hashes, for operators that work on arrays."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE = 200_000
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K1
    x = (x ^ (x >> np.uint64(29))) * _K2
    return x ^ (x >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    return mix(a * _K1 + (b ^ _K3) * _K2)


class WordHasher:
    """Hashes of the words of a text: A-Z lower-cased, cut at the six ASCII white-space characters."""

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and spaces only
        get = self.cache.get
        found = list(map(get, words))
        if None in found:
            if len(self.cache) > CACHE:
                self.cache.clear()
            for w in set(words):
                if w not in self.cache:
                    self.cache[w] = xxhash.xxh3_64_intdigest(w)
            found = list(map(self.cache.__getitem__, words))
        return np.array(found, dtype=np.uint64)
