"""Words of a text and 64-bit hashes of them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Maximal runs of letters and digits of any script.
WORD = re.compile(r"[^\W_]+")
U64 = np.uint64


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (splitmix64 finalizer)."""
    x = x.astype(U64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


class WordHash:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 500_000):
        self.seen: dict[str, int] = {}
        self.bound = bound

    def __call__(self, ws: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > self.bound:
            seen.clear()
        for w in set(ws).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter((seen[w] for w in ws), U64, len(ws))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in text order."""
    if len(h) < n:
        return np.empty(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix(out * U64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out
