"""A tree-structured graphical model over the nodes of many trees: two states a node (1 is content), one potential per
node from its features, one 2 x 2 table of potentials per kind of parent-child edge.

Sum-product passes messages from the leaves to the roots and back, for all nodes of one depth at once, so marginals are
exact. Training climbs the log-likelihood of labelled trees: its gradient is what was observed minus what the
marginals expect.
"""

from __future__ import annotations

import numpy as np


class Forest:
    """Trees laid side by side. ``parent``: place of the parent, -1 for roots; ``depth``: 0 for roots.
    ``features``: feature numbers of all nodes one after the other, ``counts`` how many each node has (at least one)."""

    def __init__(self, parent: np.ndarray, depth: np.ndarray, edge: np.ndarray, features: np.ndarray, counts: np.ndarray):
        self.parent, self.edge, self.features = parent, edge, features
        self.first = np.cumsum(counts) - counts
        self.owner = np.repeat(np.arange(len(parent)), counts)
        order = np.argsort(depth, kind="stable")
        cut = np.flatnonzero(np.diff(depth[order], prepend=-1, append=-1)) if len(parent) else np.zeros(1, np.int64)
        self.levels = [order[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def marginals(self, weights: np.ndarray, tables: np.ndarray, pairs: bool = False):
        """Probability of state 1 of each node, the log of the sum over all states of all trees, and (if asked for)
        the probabilities of the four states of each edge."""
        n = len(self.parent)
        up = np.zeros((n, 2))
        if n:
            up[:, 1] = np.add.reduceat(weights[self.features], self.first)
        message = np.zeros((n, 2))  # to the parent, by the parent's state
        for level in reversed(self.levels[1:]):
            table, own = tables[self.edge[level]], up[level]
            message[level] = np.logaddexp(table[:, :, 0] + own[:, None, 0], table[:, :, 1] + own[:, None, 1])
            for y in (0, 1):
                np.add.at(up[:, y], self.parent[level], message[level, y])
        belief = up.copy()
        both = np.zeros((n, 2, 2)) if pairs else None
        for level in self.levels[1:]:
            above = self.parent[level]
            rest = belief[above] - message[level]  # all the parent knows but for this child
            joint = rest[:, :, None] + tables[self.edge[level]]
            belief[level] = up[level] + np.logaddexp(joint[:, 0], joint[:, 1])
            if pairs:
                joint = joint + up[level][:, None, :]
                both[level] = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(level), 4), 1)[:, None, None])
        content = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))
        total = np.logaddexp(up[self.levels[0], 0], up[self.levels[0], 1]).sum() if n else 0.0
        return content, float(total), both


def fit(forest: Forest, labels: np.ndarray, n_features: int, n_edges: int, rounds: int = 250, rate: float = 0.15, decay: float = 5e-5):
    """Weights and edge tables that make the labels likely (Adam on the mean log-likelihood, with a small L2 term)."""
    weights, tables = np.zeros(n_features), np.zeros((n_edges, 2, 2))
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros_like(tables)
    np.add.at(seen, (forest.edge[child], labels[forest.parent[child]], labels[child]), 1)
    size = len(labels)
    steps = [np.zeros_like(weights), np.zeros_like(tables)], [np.zeros_like(weights), np.zeros_like(tables)]
    for t in range(1, rounds + 1):
        content, _, both = forest.marginals(weights, tables, True)
        expected = np.zeros_like(tables)
        np.add.at(expected, forest.edge[child], both[child])
        up = np.bincount(forest.features, (labels - content)[forest.owner], n_features) / size
        for k, (value, slope) in enumerate(((weights, up), (tables, (seen - expected) / size))):
            slope = slope - decay * value
            steps[0][k][:] = 0.9 * steps[0][k] + 0.1 * slope
            steps[1][k][:] = 0.99 * steps[1][k] + 0.01 * slope**2
            value += rate * (1 - t / (rounds + 1)) * (steps[0][k] / (1 - 0.9**t)) / (np.sqrt(steps[1][k] / (1 - 0.99**t)) + 1e-8)
    return weights, tables


def log_likelihood(forest: Forest, labels: np.ndarray, weights: np.ndarray, tables: np.ndarray) -> float:
    child = np.flatnonzero(forest.parent >= 0)
    own = np.add.reduceat(weights[forest.features], forest.first)[labels == 1].sum()
    return float(own + tables[forest.edge[child], labels[forest.parent[child]], labels[child]].sum() - forest.marginals(weights, tables)[1])
