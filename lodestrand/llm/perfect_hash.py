"""Minimal perfect hash over distinct 64-bit hashes, built level by level.

At each level the remaining keys are dealt to a bit array; a key alone on its bit
stays there and the others go on to the next level. A key's number is the count of
set bits before its own, so n keys have the numbers 0 to n - 1. About three to four
bits a key.
"""

from __future__ import annotations

import struct

import numpy as np

SLACK = 1.5


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """The finaliser of splitmix64, another one at each level."""
    x = keys + np.uint64((level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    def __init__(self, words: np.ndarray, sizes: list[int]) -> None:
        """words: the levels' bits, 64 to a word, each level at a word's start; sizes: words of each level."""
        self.words, self.sizes = words, sizes
        counts = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct, uint64."""
        levels, sizes, left = [], [], keys
        while len(left):
            size = max(1, int(np.ceil(SLACK * len(left) / 64)))
            at = _mixed(left, len(levels)) % np.uint64(size * 64)
            counts = np.bincount(at.astype(np.int64), minlength=size * 64)
            levels.append(np.packbits(counts == 1, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[counts[at.astype(np.int64)] > 1]
        return cls(np.concatenate(levels) if levels else np.zeros(0, "<u8"), sizes)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; -1 for some of the keys that are not in the set, any number for the others."""
        found = np.full(len(keys), -1, np.int64)
        open_, start = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = (_mixed(keys[open_], level) % np.uint64(size * 64)).astype(np.int64)
            word, bit = start + (at >> 6), (at & 63).astype(np.uint64)
            here = self.words[word]
            hit = (here >> bit) & np.uint64(1) == 1
            below = here[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            found[open_[hit]] = self.before[word[hit]] + np.bitwise_count(below)
            open_, start = open_[~hit], start + size
        return found

    def to_bytes(self) -> bytes:
        return struct.pack(f"<I{len(self.sizes)}I", len(self.sizes), *self.sizes) + self.words.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<I", data)
        return cls(np.frombuffer(data, "<u8", offset=4 + 4 * n), list(struct.unpack_from(f"<{n}I", data, 4)))
