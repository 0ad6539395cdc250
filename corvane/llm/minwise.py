"""One-permutation minwise signatures with optimal densification.

One hash per shingle gives a bin and a value; the least value of each bin is the signature.
Empty bins copy the value of a bin found by a walk that depends on the bin alone, so equal sets
keep equal signatures and the share of equal bins stays an unbiased estimate of similarity.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_EMPTY = np.uint64(2**64 - 1)
_VAL_BITS = np.uint64(40)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the worker's lifetime up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 2_000_000:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


_WORDS = WordHashes()


def words(text: str | None) -> list[str]:
    """Longest runs of letters or digits, in lower case; none for null."""
    return WORD.findall(text.lower()) if text else []


def word_hashes(ws: list[str]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, ws), dtype=np.uint64, count=len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words (with repeats), in order."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * _M1 + h[k : len(h) - n + 1 + k]
    return mix(out)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return np.unique(shingles(word_hashes(words(text)), n))


def _walk(bins: int, steps: int = 400) -> np.ndarray:
    i, j = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(steps, dtype=np.uint64), indexing="ij")
    return (mix(i * np.uint64(100003) + j + np.uint64(1)) % np.uint64(bins)).astype(np.int64)


class Signer:
    """Band keys of texts: ``bands`` keys of ``rows`` bins each."""

    def __init__(self, bands: int, rows: int) -> None:
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.walk = _walk(self.bins)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """len(sets) x bins; rows of empty sets stay all empty."""
        d = len(sets)
        sig = np.full(d * self.bins, _EMPTY, np.uint64)
        sizes = np.fromiter((len(s) for s in sets), np.int64, d)
        if sizes.sum():
            h = np.concatenate(sets)
            cell = np.repeat(np.arange(d, dtype=np.uint64), sizes) * np.uint64(self.bins) + (h >> _VAL_BITS) % np.uint64(self.bins)
            val = h & np.uint64(2**40 - 1)
            order = np.lexsort((val, cell))
            cell, val = cell[order], val[order]
            first = np.r_[True, cell[1:] != cell[:-1]]
            sig[cell[first].astype(np.int64)] = val[first]
        sig = sig.reshape(d, self.bins)
        base, filled = sig.copy(), sizes > 0
        for t in range(self.walk.shape[1]):
            gap = (sig == _EMPTY) & filled[:, None]
            if not gap.any():
                break
            r, c = np.nonzero(gap)
            sig[r, c] = base[r, self.walk[c, t]]
        # sets of very few shingles: what the walk has not reached takes the first filled bin
        gap = (sig == _EMPTY) & filled[:, None]
        if gap.any():
            r, c = np.nonzero(gap)
            sig[r, c] = base[r, (base[r] != _EMPTY).argmax(axis=1)]
        return sig

    def keys(self, sets: list[np.ndarray]) -> list[np.ndarray]:
        """Per set, ``bands`` 64-bit keys, each of its band alone; empty for an empty set."""
        sig = self.signatures(sets).reshape(len(sets), self.bands, self.rows)
        k = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64), sig.shape[:2])
        for r in range(self.rows):
            k = mix(k * _M1 + sig[:, :, r] + np.uint64(1))
        k = k.view(np.int64)
        return [k[i] if len(s) else k[i][:0] for i, s in enumerate(sets)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets of hashes; 0 if either is empty."""
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)
