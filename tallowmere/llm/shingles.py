"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * _M2
    h = (h ^ (h >> np.uint64(29))) * _M1
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """The distinct shingles of `width` words, sorted; a shorter text's whole sequence as one; none without words.

    Words are what ASCII white space separates, with A-Z in lower case.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(words, dtype=object), categorize=False)
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, np.uint64(n))
    for k in range(n):
        out = mix(out + h[k : len(h) - n + 1 + k]) * _M1
    return np.unique(mix(out))
