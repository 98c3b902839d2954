"""Sets of word shingles as sorted 64-bit hashes, and their minhash signatures."""

from __future__ import annotations

import numpy as np
import xxhash

_MOST_WORDS = 100_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _MOST_WORDS:
            self[word] = value
        return value


_WORDS = _Words()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct shingles of ``words`` words, A-Z lowered, cut at ASCII white space; sorted 64-bit hashes.

    A text with fewer words is one shingle, all its words; without words the set is empty."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.empty(0, "uint64")
    if len(tokens) < words:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join([b"", *tokens]))], "uint64")
    ids = np.fromiter(map(_WORDS.__getitem__, tokens), "uint64", len(tokens))
    n = len(ids) - words + 1
    total = np.zeros(n, "uint64")
    for k in range(words):
        total = _mixed(total * _MIX[0] + ids[k : k + n])
    return np.unique(total)


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.default_rng(seed).integers(0, 2**64, (2, count), "uint64", endpoint=False)
    return made[0], made[1] | np.uint64(1)


def signature(shingles: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least of each permutation's values, mixed down to 16 bits: different minima agree once in 65,536, which only lets a
    pair through to the exact test. Long sets go through a piece at a time."""
    best = np.full(len(flips), np.iinfo("uint64").max, "uint64")
    for i in range(0, len(shingles), 1024):
        values = shingles[None, i : i + 1024] ^ flips[:, None]
        values *= factors[:, None]
        np.minimum(best, values.min(axis=1), out=best)
    return _mixed(best).astype("<u2")


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
