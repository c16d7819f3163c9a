"""Min-max hashing: under each permutation the smallest and the largest hash of a set are kept, so half the
permutations give the same number of signature values, with lower variance."""

from __future__ import annotations

import numpy as np

from llm.hashing import U, mix

_SEEDS = np.random.default_rng(20240715).integers(1, 1 << 62, 4096, dtype=np.uint64)


def signatures(hashes: np.ndarray, counts: np.ndarray, permutations: int) -> np.ndarray:
    """(sets, 2 * permutations) values; ``hashes`` holds the sets one after the other, none of them empty."""
    start = np.cumsum(counts) - counts
    x = (hashes >> U(32)).astype(np.uint32)
    out = np.empty((len(counts), 2 * permutations), np.uint32)
    h = np.empty_like(x)
    for k in range(permutations):
        # an odd factor permutes the 32-bit numbers
        np.multiply(x, np.uint32(int(_SEEDS[2 * k]) & 0xFFFFFFFF | 1), out=h)
        np.add(h, np.uint32(int(_SEEDS[2 * k + 1]) & 0xFFFFFFFF), out=h)
        out[:, 2 * k] = np.minimum.reduceat(h, start)
        out[:, 2 * k + 1] = np.maximum.reduceat(h, start)
    return out


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """(sets, bands) 64-bit keys; a band is ``rows`` neighbouring values, and its number is part of the key."""
    bands = signature.shape[1] // rows
    keys = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, np.uint64) * U(0x9E3779B97F4A7C15)
        for r in range(rows):
            key = mix(key + signature[:, b * rows + r].astype(np.uint64) * U(0xD1342543DE82EF95) + U(1))
        keys[:, b] = key
    return keys.view(np.int64)
