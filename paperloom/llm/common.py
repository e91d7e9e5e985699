"""What several training-text operators share."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: A word: a longest run of letters and digits.
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (xor-shift-multiply), for unsigned integers, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Hasher:
    """64-bit symbols of words, remembered within a worker."""

    def __init__(self, most: int = 500_000) -> None:
        self.seen: dict[str, int] = {}
        self.most = most

    def __call__(self, ws: list[str]) -> np.ndarray:
        seen = self.seen
        for w in set(ws):
            if w not in seen:
                if len(seen) >= self.most:
                    seen.clear()
                    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in ws), np.uint64, len(ws))
                seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, ws), np.uint64, len(ws))
