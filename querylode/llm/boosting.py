"""Gradient-boosted trees for two classes and isotonic calibration, small enough for a bounded sample on one machine."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Tree:
    """Nodes in arrays: a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[node] >= 0)
            if not len(inner):
                return self.value[node]
            at = node[inner]
            node[inner] = np.where(x[inner, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])


@dataclass(frozen=True)
class Booster:
    start: float
    trees: tuple[Tree, ...]
    rate: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.trees:
            total += self.rate * tree(x)
        return total


def grow(binned: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, depth: int, least: float, ridge: float) -> Tree:
    """One tree by second-order gain over the features' bins."""
    rows = [np.arange(len(slope))]
    feature, cut, left, right, value = [-1], [0.0], [0], [0], [0.0]
    levels = [0]
    at = 0
    while at < len(rows):
        r = rows[at]
        g, h = slope[r].sum(), curve[r].sum()
        value[at] = -g / (h + ridge)
        best = (1e-6, -1, -1)
        if levels[at] < depth and len(r) > 1:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[r, f]
                gl = np.cumsum(np.bincount(b, slope[r], len(e) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, curve[r], len(e) + 1))[:-1]
                gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g**2 / (h + ridge)
                gain[(hl < least) | (h - hl < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), f, k)
        if best[1] >= 0:
            f, k = best[1:]
            goes = binned[r, f] <= k
            feature[at], cut[at] = f, float(edges[f][k])
            left[at], right[at] = len(rows), len(rows) + 1
            for part in (r[goes], r[~goes]):
                rows.append(part)
                levels.append(levels[at] + 1)
                for column, blank in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, 0.0)):
                    column.append(blank)
        at += 1
    return Tree(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 2.0, ridge: float = 1.0) -> Booster:
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return Booster(start, (), rate)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    total, made = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        tree = grow(binned, edges, p - y, p * (1 - p), depth, least, ridge)
        made.append(tree)
        total += rate * tree(x)
    return Booster(start, tuple(made), rate)


@dataclass(frozen=True)
class Isotonic:
    """A non-decreasing step function through pooled adjacent means, linear between them."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return np.interp(z, self.at, self.value) if len(self.at) else 1 / (1 + np.exp(-z))


def calibrate(z: np.ndarray, y: np.ndarray) -> Isotonic:
    if len(set(y.tolist())) < 2:
        return Isotonic(np.zeros(0), np.zeros(0))
    order = np.argsort(z, kind="stable")
    pools: list[list[float]] = []  # sum of y, count, least z, greatest z
    for a, b in zip(z[order].tolist(), y[order].tolist(), strict=True):
        if pools and pools[-1][3] == a:
            pools[-1][0] += b
            pools[-1][1] += 1
        else:
            pools.append([b, 1, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, _, high = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = high
    points = [(edge, (s + 0.5) / (n + 1) if 0 < s < n else min(max(s / n, 0.5 / (n + 1)), (n + 0.5) / (n + 1))) for s, n, low, high in pools for edge in ((low, high) if low < high else (low,))]
    values = np.maximum.accumulate(np.array([v for _, v in points]))
    return Isotonic(np.array([a for a, _ in points]), values)
