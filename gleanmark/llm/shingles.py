"""Word shingles of whole texts as 64-bit hashes, and min-hash signatures of them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words of a shingle.
WIDTH = 5
# Latin letters first, which are told fastest.
_WORDS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+[^\W_一-鿿]*|[一-鿿]|[^\W_一-鿿]+")
_MIX = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class _Known(dict):
    def __missing__(self, w: str) -> int:
        h = self[w] = xxhash.xxh3_64_intdigest(w) >> 1 << 1 | ("一" <= w <= "鿿")
        return h


class Words:
    """Hashes of words; those seen before are kept, up to a bound. The last bit says whether a word is a Han character."""

    def __init__(self, bound: int = 300_000):
        self.bound, self.known = bound, _Known()

    def hashes(self, text: str) -> np.ndarray:
        if len(self.known) > self.bound:
            self.known.clear()
        words = _WORDS.findall(text.lower())
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def runs(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hash of each run of ``width`` words, in order; a shorter text is one run."""
    if len(words) == 0:
        return words
    if len(words) < width:
        width = len(words)
    total = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for k in range(width):
        total = total * np.uint64(0x100000001B3) + words[k : len(words) - width + 1 + k]
    total ^= total >> np.uint64(29)
    return total * np.uint64(0xBF58476D1CE4E5B9)


def shingles(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Distinct shingles of ``width`` words; a shorter text is one shingle."""
    return np.unique(runs(words, width))


def signature(parts: np.ndarray, size: int) -> np.ndarray:
    """Min-hash of the shingles under ``size`` permutations."""
    mixed = parts[None, :] * _MIX[:size, None]
    mixed ^= mixed >> np.uint64(31)
    return mixed.min(axis=1)


def signatures(parts: np.ndarray, sizes: np.ndarray, size: int) -> np.ndarray:
    """Min-hashes of several sets of shingles, none of them empty, that lie one after the other: one column a set."""
    first = np.cumsum(sizes) - sizes
    out = np.empty((size, len(sizes)), dtype=np.uint64)
    for k in range(size):
        mixed = parts * _MIX[k]
        mixed ^= mixed >> np.uint64(31)
        np.minimum.reduceat(mixed, first, out=out[k])
    return out


def mixers(size: int) -> np.ndarray:
    """Odd factors of the permutations."""
    return _MIX[:size]


def count_of(text: str) -> int:
    """Words of a text."""
    return len(_WORDS.findall(text.lower()))


def bands(sig: np.ndarray, rows: int) -> np.ndarray:
    """One signed key per band of ``rows`` values, of one signature or of each column; bands differ even where their values agree."""
    folded = sig.reshape(-1, rows, *sig.shape[1:])
    key = np.arange(len(folded), dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    key = key.reshape(-1, *[1] * (sig.ndim - 1))
    for k in range(rows):
        key = (key ^ folded[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)
