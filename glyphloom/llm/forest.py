"""A random forest of classification trees in numpy, trained on few rows and sent to tasks as arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Node i asks whether x[feature] <= threshold and goes on to left or right; a leaf has feature -1 and a share."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        live = np.flatnonzero(self.feature[at] >= 0)
        while len(live):
            node = at[live]
            at[live] = np.where(x[live, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            live = live[self.feature[at[live]] >= 0]
        return self.share[at]


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[int, float] | None:
    """The split of the lowest Gini impurity among some features."""
    best, found = 2 * y.mean() * (1 - y.mean()) * len(y) - 1e-9, None
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, hits = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y))
        a, b = hits[:-1] / n, (hits[-1] - hits[:-1]) / (len(y) - n)
        impurity = 2 * n * a * (1 - a) + 2 * (len(y) - n) * b * (1 - b)
        impurity[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        i = int(impurity.argmin()) if len(impurity) else 0
        if len(impurity) and impurity[i] < best:
            best, found = impurity[i], (int(f), float((v[i] + v[i + 1]) / 2))
    return found


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> Tree:
    nodes: list[list] = []
    todo = [(np.arange(len(y)), 0, -1, "")]
    while todo:
        rows, level, parent, side = todo.pop()
        here = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y[rows].mean())])
        if parent >= 0:
            nodes[parent][2 if side == "left" else 3] = here
        if level == depth or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            continue
        some = rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False)
        if (split := _split(x[rows], y[rows], some, least)) is None:
            continue
        nodes[here][:2] = split
        goes = x[rows, split[0]] <= split[1]
        todo += [(rows[goes], level + 1, here, "left"), (rows[~goes], level + 1, here, "right")]
    feature, threshold, left, right, share = zip(*nodes, strict=True)
    return Tree(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(share))


@dataclass
class Forest:
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 1) -> Forest:
    """Each tree sees rows drawn with repeats, and at each node the square root of the number of features."""
    rng = np.random.default_rng(seed)
    draws = (rng.integers(0, len(y), len(y)) for _ in range(trees))
    return Forest([_grow(x[d], y[d], rng, depth, least) for d in draws])
