"""Hashes of words and word shingles with numpy, for use inside Arrow functions."""

from __future__ import annotations

import numpy as np
import xxhash

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_known: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; those of frequent words are kept, up to a bound."""
    if len(_known) > 100_000:
        _known.clear()
    known, put, digest = _known.get, _known.setdefault, xxhash.xxh3_64_intdigest
    return np.fromiter((known(w) or put(w, digest(w)) for w in words), np.uint64, len(words))


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; empty if there are fewer words."""
    n = len(hashes) - size + 1
    out = np.zeros(max(0, n), np.uint64)
    for i in range(size if n > 0 else 0):
        out = out * _FACTOR + hashes[i : i + n]
    return mix(out)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words, A-Z lower-cased; one of all words if there are fewer; empty for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    taken = min(size, len(words))
    return np.unique(mix(rolling(word_hashes(words), taken) + np.uint64(taken)))
