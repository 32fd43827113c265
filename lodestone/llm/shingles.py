"""Word shingles as sorted 64-bit sets, and MinHash signatures over them (numpy, no Spark)."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
CACHE_WORDS = 400_000
_U = np.uint64


class _WordHashes(dict):
    """Word bytes to 64-bit hash, computed on the first miss."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = _WordHashes()


def _multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * _U(2) + _U(1)


_POSITION = _multipliers(16, 5)


def mixed_bits(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0x9E3779B97F4A7C15)
    return h ^ (h >> _U(29))


def shingle_set(text: str | None, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of ``text``.

    A-Z are lower-cased; words are runs of non ASCII white space. A text of one to
    ``width - 1`` words gives one shingle, its whole sequence; no words, none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, _U)
    if len(_words) > CACHE_WORDS:
        _words.clear()
    w = np.fromiter(map(_words.__getitem__, words), _U, len(words))
    k = min(width, len(words))
    n = len(words) - k + 1
    h = np.full(n, _U((k * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
    for i in range(k):
        h = h + w[i : i + n] * _POSITION[i]
    return np.unique(mixed_bits(h))


class MinHasher:
    """``k`` minima per set over 32-bit hashes, kept as 16-bit values."""

    def __init__(self, k: int, seed: int = 11):
        self.mul = (_multipliers(k, seed) >> _U(32)).astype(np.uint32) | np.uint32(1)
        self.xor = (_multipliers(k, seed + 1) >> _U(32)).astype(np.uint32)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        best = np.full(len(self.mul), 0xFFFFFFFF, np.uint32)
        short = (hashes >> _U(32)).astype(np.uint32)
        for at in range(0, len(short), 256):
            part = short[at : at + 256, None] ^ self.xor
            np.multiply(part, self.mul, out=part)
            np.minimum(best, part.min(axis=0), out=best)
        # the minimum's high bits are small by nature, so fold all its bits into the sixteen
        return (mixed_bits(best.astype(np.uint64)) >> _U(48)).astype(">u2")


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return both, len(a) + len(b) - both
