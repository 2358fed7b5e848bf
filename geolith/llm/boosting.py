"""Histogram gradient-boosted trees for a binary label, in numpy.

Features are cut into at most ``bins`` quantile bins. Trees grow level by level: one bincount per feature gives gradient and hessian
histograms of all open nodes, and the best cut of each node splits it. All trees lie in flat arrays (feature, cut, left child, leaf
value), which scoring walks for all rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # -1 at a leaf
    cut: np.ndarray  # rows with feature <= cut go to child, others to child + 1
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > self.cut[node]
                node = np.where(inner, self.child[node] + right, node)
            total += self.value[node]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 8) -> Trees:
    """x: rows by features, finite; y: 0 or 1. Without rows of both labels the score is the share of label 1 (none: 0.5)."""
    n = len(y)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(share / (1 - share)))
    nodes: list[list] = []  # feature, cut, child, value
    roots = []
    if n and y.min() != y.max():
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        raw = np.full(n, base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            roots.append(len(nodes))
            nodes.append([-1, 0.0, 0, 0.0])
            open_nodes, where = [len(nodes) - 1], np.zeros(n, np.int64)  # where: index in open_nodes, or -1
            leaf = np.full(n, len(nodes) - 1)
            for level in range(depth + 1):
                k, live = len(open_nodes), np.flatnonzero(where >= 0)
                if not k:
                    break
                gs, hs = (np.bincount(where[live], v[live], k) for v in (g, h))
                for i, node in enumerate(open_nodes):
                    nodes[node][3] = rate * gs[i] / (hs[i] + l2)
                if level == depth:
                    break
                best = np.full(k, 1e-6)
                choice = [(-1, 0)] * k
                for f in range(x.shape[1]):
                    size = len(cuts[f]) + 1
                    at = where[live] * size + binned[live, f]
                    hg, hh, hn = (np.bincount(at, w, k * size).reshape(k, size).cumsum(1)[:, :-1] for w in (g[live], h[live], None))
                    if not hg.size:
                        continue
                    whole = np.bincount(where[live], minlength=k)[:, None]
                    gain = hg**2 / (hh + l2) + (gs[:, None] - hg) ** 2 / (hs[:, None] - hh + l2) - (gs**2 / (hs + l2))[:, None]
                    gain[(hn < least) | (whole - hn < least)] = -1
                    top = gain.argmax(1)
                    for i in np.flatnonzero(gain[np.arange(k), top] > best):
                        best[i], choice[i] = gain[i, top[i]], (f, int(top[i]))
                after, goes = [], np.full(n, -1)
                for i, (f, b) in enumerate(choice):
                    if f < 0:
                        continue
                    nodes[open_nodes[i]][:3] = [f, float(cuts[f][b]), len(nodes)]
                    rows = np.flatnonzero(where == i)
                    right = binned[rows, f] > b
                    leaf[rows] = len(nodes) + right
                    goes[rows] = len(after) + right
                    after += [len(nodes), len(nodes) + 1]
                    nodes += [[-1, 0.0, 0, 0.0], [-1, 0.0, 0, 0.0]]
                open_nodes, where = after, goes
            raw += np.array([node[3] for node in nodes])[leaf]
    columns = list(zip(*nodes, strict=True)) if nodes else [(), (), (), ()]
    return Trees(base, np.array(columns[0], np.int64), np.array(columns[1], float), np.array(columns[2], np.int64), np.array(columns[3], float), np.array(roots, np.int64), depth)
