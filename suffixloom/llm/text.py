"""Words and word shingles of a text as 64-bit hashes (numpy, used inside Arrow batches)."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S31, _S29 = np.uint64(31), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> _S31)) * _M2
    return (x ^ (x >> _S29)) * _M1


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z: `bytes` methods know ASCII only, as wanted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words, in order; with fewer words one for the whole sequence; none without words."""
    if not len(words):
        return words
    width = min(n, len(words))
    out = mix(words[: len(words) - width + 1])
    for i in range(1, width):
        out = mix(out * _M1 + words[i : len(words) - width + 1 + i])
    return out if width == n else mix(out ^ np.uint64(width))
