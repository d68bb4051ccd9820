"""Minimal perfect hashing of distinct integers: cascades of bit vectors, built by slices, asked for many keys at once."""

from __future__ import annotations

from math import gcd

import numpy as np

#: Bits of a level for each key that reaches it.
SPREAD = 2
#: Keys of a slice; a slice is built in one task.
SLICE_KEYS = 1 << 16


def slice_count(n_keys: int, slice_keys: int = SLICE_KEYS) -> int:
    """How many slices `key % slices` makes of so many keys; prime to ten, so that round factors in keys cannot align."""
    n = max(1, -(-n_keys // slice_keys))
    while gcd(n, 10) > 1:
        n += 1
    return n


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A hash of each key (the finalizer of splitmix64), another one for each level."""
    z = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits of each level, words): keys that are alone at their bit of a level set it, the others go on to the next."""
    sizes, words, rest, level = [], [], keys, 0
    while len(rest):
        size = -(-SPREAD * len(rest) // 64) * 64
        at = (mixed(rest, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, bool)
        bits[at[alone]] = True
        words.append(np.packbits(bits, bitorder="little").view("<u8"))
        sizes.append(size)
        rest, level = rest[~alone], level + 1
    return np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, "<u8")


class PerfectHash:
    """The functions of some slices side by side. A key's index counts the bits before its own, over all these slices."""

    def __init__(self, n_slices: int, functions: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.n_slices = n_slices
        self.place = np.full(n_slices, -1, np.int64)
        self.place[list(functions)] = np.arange(len(functions))
        depth = max((len(sizes) for sizes, _ in functions.values()), default=0)
        self.sizes = np.zeros((len(functions), depth), np.int64)
        for i, (sizes, _) in enumerate(functions.values()):
            self.sizes[i, : len(sizes)] = sizes
        ends = np.cumsum(self.sizes).reshape(self.sizes.shape)
        self.starts = ends - self.sizes
        self.words = np.concatenate([np.zeros(0, "<u8"), *(words for _, words in functions.values())]).astype(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, one of another key or -1 for those that the functions were not built for."""
        found = np.full(len(keys), -1, np.int64)
        place = self.place[keys % self.n_slices]
        rest = np.flatnonzero(place >= 0)
        for level in range(self.sizes.shape[1]):
            rest = rest[self.sizes[place[rest], level] > 0]
            if not len(rest):
                break
            own = place[rest]
            bit = self.starts[own, level] + (mixed(keys[rest], level) % self.sizes[own, level].astype(np.uint64)).astype(np.int64)
            word, shift = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            hit = (word >> shift & np.uint64(1)).astype(bool)
            below = word[hit] & ((np.uint64(1) << shift[hit]) - np.uint64(1))
            found[rest[hit]] = self.before[bit[hit] >> 6] + np.bitwise_count(below).astype(np.int64)
            rest = rest[~hit]
        return found
