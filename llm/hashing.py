"""Hashes of words, lines and byte windows of many texts at once, with numpy.

``Prefix`` keeps prefix sums of byte codes times powers of an odd number, modulo 2^64; the hash of any
stretch of bytes is a difference of two sums, taken back to power 0 and mixed, so equal stretches have
equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: After lower-casing: ASCII that is no digit and no letter.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:48] = True
NOT_ALNUM[58:97] = True
NOT_ALNUM[123:128] = True

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, step in (("up", BASE), ("down", INVERSE)):
            steps = np.full(n, step, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser (two multiply and shift rounds)."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xC2B2AE3D27D4EB4F)
    x ^= x >> U(32)
    return x


class Prefix:
    def __init__(self, raw: np.ndarray):
        up, self.down = powers(len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(CODES[raw] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of the bytes from start to end, for each pair."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * U(0x632BE59BD9B4E019))


#: Bytes that are hashed at once.
CHUNK = 1 << 20


def word_hashes(raw: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of all texts (A-Z in lower case); ``outside`` says which bytes are in no word.

    Works on ``CHUNK`` bytes at a time, so that long texts need little more than the result; a word that crosses a border
    is put together from its parts and has the hash it has anywhere.
    """
    starts, hashes = [], []
    edge = np.unique(offsets)
    held = None  # start, sum of codes, length of a word that is not ended
    finish = lambda total, length: mix(total + length.astype(np.uint64) * U(0x632BE59BD9B4E019))
    for at in range(0, len(raw), CHUNK):
        part = LOWER[raw[at : at + CHUNK]]
        inside = ~outside[part]
        own = edge[np.searchsorted(edge, at) : np.searchsorted(edge, at + len(part), "right")] - at
        start, end = runs(inside, np.unique(np.concatenate([[0], own, [len(part)]])))
        prefix = Prefix(part)
        total = (prefix.sums[end] - prefix.sums[start]) * prefix.down[start]
        length = end - start
        start = start + at
        if held is not None:
            if inside[0] and not (len(own) and own[0] == 0):
                total[0] = U((held[1] + int(total[0]) * pow(BASE, held[2], 1 << 64)) & 0xFFFFFFFFFFFFFFFF)
                length[0] += held[2]
                start[0] = held[0]
            else:
                starts.append(np.array([held[0]], np.int64))
                hashes.append(finish(np.array([held[1]], np.uint64), np.array([held[2]])))
            held = None
        if len(end) and end[-1] == len(part) and at + len(part) < len(raw) and not (len(own) and own[-1] == len(part)):
            held = int(start[-1]), int(total[-1]), int(length[-1])
            start, total, length = start[:-1], total[:-1], length[:-1]
        starts.append(start)
        hashes.append(finish(total, length))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true places; a run ends where a text ends."""
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < len(inside)]
    start[edge] = inside[edge]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    last = edge[edge > 0] - 1
    stop[last] = inside[last]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
