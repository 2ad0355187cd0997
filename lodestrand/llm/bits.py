"""Votes of hashes on the bits of fingerprints, many texts at a time."""

from __future__ import annotations

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def bit_sums(hashes: np.ndarray, owner: np.ndarray, texts: int, weights: np.ndarray | None = None) -> np.ndarray:
    """How much weight each bit of 64 gets: for each text, the sum over its hashes that have the bit set.

    Hash bytes are tallied per text and place, so a hash costs eight additions and
    a text one small matrix product.
    """
    sums = np.zeros((texts, 64))
    step = 256
    order = np.searchsorted(owner, np.arange(0, texts + step, step))
    for k, first in enumerate(range(0, texts, step)):
        part = slice(order[k], order[k + 1])
        n = min(step, texts - first)
        octets = hashes[part].astype("<u8").view(np.uint8).reshape(-1, 8)
        place = ((owner[part] - first) * 2048)[:, None] + np.arange(0, 2048, 256) + octets
        w = None if weights is None else np.repeat(weights[part], 8)
        tally = np.bincount(place.ravel(), w, n * 2048).reshape(n * 8, 256)
        sums[first : first + n] = (tally @ _BITS).reshape(n, 64)
    return sums


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 truth values as unsigned numbers."""
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
