"""Word shingles as 64-bit hashes, and min-wise signatures over them (numpy)."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[a-z0-9_]+")
_M = np.uint64(0x9E3779B97F4A7C15)
_S31, _S29, _S32 = np.uint64(31), np.uint64(29), np.uint64(32)


class _WordHashes(dict):
    """Word to 64-bit hash; emptied when it grows beyond a bound."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def words(text: str | None) -> list[str]:
    """Maximal runs of a-z, 0-9 and _ in the lower-cased text; none for null."""
    return WORD.findall(text.lower()) if text else []


def mix(g: np.ndarray) -> np.ndarray:
    g = g ^ (g >> _S29)
    g = g * _M
    return g ^ (g >> _S32)


def word_hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, ws), np.uint64, len(ws))


def ngram_hashes(a: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word runs, in order of place."""
    n = len(a) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    g = a[:n]
    for j in range(1, k):
        g = (g ^ (g >> _S31)) * _M + a[j : j + n]
    return mix(g)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word runs of a text."""
    return np.unique(ngram_hashes(word_hashes(words(text)), k))


def exact_jaccard(a: str, b: str, k: int) -> float:
    """Jaccard similarity of the sets of k-word runs themselves, without hashing."""
    x, y = exact_set(a, k), exact_set(b, k)
    return jaccard(x, y)


def exact_set(text: str | None, k: int) -> frozenset:
    ws = words(text)
    return frozenset(zip(*(ws[j:] for j in range(k)))) if len(ws) >= k else frozenset()


def jaccard(x: frozenset, y: frozenset) -> float:
    both = len(x & y)
    return both / (len(x) + len(y) - both) if both else 0.0


class MinHasher:
    """``size`` min-wise functions, the same in every process."""

    def __init__(self, size: int, seed: int = 20240607):
        rng = np.random.default_rng(seed)
        self.size = size
        self.a = rng.integers(1, 2**63, size, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**63, size, dtype=np.uint64)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """Minima (32 bits each) of a non-empty set; in chunks, so long texts need no large matrix."""
        out = np.full(self.size, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 2048):
            out = np.minimum(out, (s[i : i + 2048, None] * self.a + self.b).min(0))
        return (out >> _S32).astype(np.uint32)
