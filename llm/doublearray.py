"""A double-array trie over dense codes, built and walked for many sequences at once.

A state is a place in two arrays. The child of state s by code c is t = BASE[s] + c, and it exists if CHECK[t] = s.
Codes are 0, 1, ... in the order in which the levels of the trie first meet them, so siblings have close codes and
the arrays stay compact: a state with one child takes the next free place, one with several looks at a bounded
number of free places and else goes behind all others.
"""

from __future__ import annotations

import numpy as np

#: Free places that a state with several children looks at.
TRIES = 32


class DoubleArray:
    def __init__(self, codes: np.ndarray, length: np.ndarray):
        """``codes``: the sequences one after the other, ``length`` of each."""
        self.start = np.cumsum(length) - length
        self.length = length
        levels, codes = self.levels(codes)
        self.codes = codes
        self.base = np.zeros(16, np.int64)
        self.check = np.full(16, -1, np.int64)
        self.free = 1  # all places before it are taken; place 0 is the root
        self.end = 1  # all places from here on are free
        self.pack(levels)

    def levels(self, codes: np.ndarray) -> tuple[list, np.ndarray]:
        """Per depth the distinct (parent number, code) pairs, parents numbered in order; and the codes renumbered."""
        node = np.zeros(len(self.length), np.int64)
        wide = int(codes.max()) + 1 if len(codes) else 1
        out, active, depth = [], np.flatnonzero(self.length > 0), 0
        while len(active):
            pair, place = np.unique(node[active] * wide + codes[self.start[active] + depth], return_inverse=True)
            node[active] = place
            out.append((pair // wide, pair % wide))
            depth += 1
            active = active[self.length[active] > depth]
        if not out:
            return out, codes
        met = np.concatenate([code for _, code in out])
        known, first = np.unique(met, return_index=True)
        new = np.empty(wide, np.int64)
        new[known[np.argsort(first)]] = np.arange(len(known))
        return [(parent, new[code]) for parent, code in out], new[codes]

    def grow(self, size: int) -> None:
        if size > len(self.base):
            more = max(size, 2 * len(self.base)) - len(self.base)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def next_free(self, at: int) -> int:
        while at < self.end and self.check[at] >= 0:
            at += 1
        return at

    def pack(self, levels: list) -> None:
        self.check[0] = 0
        states = np.zeros(1, np.int64)
        for parent, code in levels:
            # children of one parent together, by rising code
            order = np.lexsort((code, parent))
            sorted_code = code[order]
            cut = np.flatnonzero(np.diff(parent[order], prepend=-1, append=-1))
            child = np.empty(len(code), np.int64)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                own = sorted_code[a:b]
                state = states[parent[order[a]]]
                base = self.place(own)
                self.base[state] = base
                child[a:b] = base + own
                self.check[child[a:b]] = state
                self.end = max(self.end, base + int(own[-1]) + 1)
            states = np.empty(len(code), np.int64)
            states[order] = child
        self.base, self.check = self.base[: self.end], self.check[: self.end]

    def place(self, own: np.ndarray) -> int:
        """A base at which all children find free places."""
        low, high = int(own[0]), int(own[-1])
        self.free = at = self.next_free(self.free)
        for _ in range(1 if high == low else TRIES):
            base = at - low
            self.grow(base + high + 1)
            if high == low or not (self.check[base + own] >= 0).any():
                return base
            at = self.next_free(at + 1)
        self.grow(self.end + high - low + 1)
        return self.end - low

    def walk(self):
        """For each depth from 1: which sequences reach it, and their states."""
        active, state, depth = np.flatnonzero(self.length > 0), np.zeros(len(self.length), np.int64), 0
        while len(active):
            to = self.base[state[active]] + self.codes[self.start[active] + depth]
            if not (self.check[to] == state[active]).all():
                raise ValueError("a sequence left the trie")
            state[active] = to
            yield active, to
            depth += 1
            active = active[self.length[active] > depth]
