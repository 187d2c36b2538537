"""Binary classification trees over a bounded training matrix (numpy, on the driver)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    """A split `feature <= threshold` (left: yes), or a leaf with the share of the positive class."""

    value: float
    weight: float
    feature: int = -1
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


def cuts(x: np.ndarray, bins: int = 32) -> list[np.ndarray]:
    """Candidate thresholds of each feature: midpoints between quantiles of its distinct values."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(values, np.linspace(0, 1, bins)))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, edges: list[np.ndarray], depth: int, leaf: float, rng: np.random.Generator, tries: int) -> Node:
    """A tree by Gini impurity; each split looks at `tries` features drawn at random."""
    total, positive = w.sum(), (w * y).sum()
    node = Node(float(positive / total) if total else 0.5, float(total))
    if depth == 0 or len(y) < 2 or positive <= 1e-12 or total - positive <= 1e-12:
        return node
    best = (1e-9, -1, 0.0)
    gini = lambda p, t: p * (t - p) / np.maximum(t, 1e-12)
    here = gini(positive, total)
    for j in rng.choice(x.shape[1], min(tries, x.shape[1]), replace=False):
        if not len(edges[j]):
            continue
        at = np.searchsorted(edges[j], x[:, j], side="left")  # x <= edge
        t = np.cumsum(np.bincount(at, w, len(edges[j]) + 1))[:-1]
        p = np.cumsum(np.bincount(at, w * y, len(edges[j]) + 1))[:-1]
        gain = here - gini(p, t) - gini(positive - p, total - t)
        gain[(t < leaf) | (total - t < leaf)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], int(j), float(edges[j][k]))
    if best[1] < 0:
        return node
    node.feature, node.threshold = best[1], best[2]
    yes = x[:, node.feature] <= node.threshold
    node.left = grow(x[yes], y[yes], w[yes], edges, depth - 1, leaf, rng, tries)
    node.right = grow(x[~yes], y[~yes], w[~yes], edges, depth - 1, leaf, rng, tries)
    return node


def forest(x: np.ndarray, y: np.ndarray, trees: int, depth: int, leaf: float = 5, seed: int = 1, tries: int | None = None, balance: bool = True) -> list[Node]:
    """Trees over bootstrap samples; with `balance` both classes weigh the same."""
    rng, n = np.random.default_rng(seed), len(y)
    edges, tries, out = cuts(x), tries or max(1, round(x.shape[1] ** 0.5)), []
    base = np.where(y > 0, n / max(1, 2 * y.sum()), n / max(1, 2 * (n - y.sum()))) if balance else np.ones(n)
    for _ in range(trees):
        pick = rng.integers(0, n, n)
        out.append(grow(x[pick], y[pick], base[pick], edges, depth, leaf, rng, tries))
    return out


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    yes = x[:, node.feature] <= node.threshold
    out = np.empty(len(x))
    out[yes], out[~yes] = predict(node.left, x[yes]), predict(node.right, x[~yes])
    return out


def paths(node: Node, above: tuple = ()) -> list[tuple[tuple[int, bool, float], ...]]:
    """Every path from the root to a node below it, as (feature, at most, threshold) conditions."""
    if node.feature < 0:
        return []
    out = []
    for below, low in ((node.left, True), (node.right, False)):
        path = (*above, (node.feature, low, node.threshold))
        out += [path, *paths(below, path)]
    return out
