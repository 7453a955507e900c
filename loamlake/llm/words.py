"""Words and word hashes of whole texts, vectorised over one document at a time."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class WordHashes(dict):
    """Word bytes to a signed 64-bit hash that every process computes alike; emptied when it holds a million."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        return value


def lower_words(text: str | None) -> list[bytes]:
    """bytes.lower folds only A-Z, and bytes.split cuts at exactly the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per window of ``width`` word hashes (uint64 in and out); fewer words make one window."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(n, width)
    out = np.zeros(n - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * _MULTIPLIER + hashes[k : n - size + 1 + k]
        out += np.uint64(size)
        out ^= out >> np.uint64(33)
        out *= _MIX
        out ^= out >> np.uint64(33)
    return out


def shingle_set(words: list[bytes], cache: WordHashes, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes (int64) of a document; empty without words."""
    if not words:
        return np.empty(0, np.int64)
    hashes = np.array([cache[w] for w in words], np.int64).view(np.uint64)
    return np.unique(window_hashes(hashes, width).view(np.int64))
