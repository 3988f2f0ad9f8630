"""Gradient-boosted trees, isotonic calibration and lasso logistic regression in numpy.

They are fitted on bounded samples that have already been reduced to dense features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A binary tree in arrays; a node whose feature is -1 is a leaf."""

    feature: list
    threshold: list
    left: list
    right: list
    value: list

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            go = x[rows, feature[node]] <= threshold[node]
            at[rows] = np.where(go, left[node], right[node])
        return value[at]


def edges_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Candidate thresholds of each feature: midpoints between sample quantiles."""
    out = []
    for column in x.T:
        points = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
        out.append((points[:-1] + points[1:]) / 2)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def grow(binned: np.ndarray, edges: list, g: np.ndarray, h: np.ndarray, depth: int, least: int, l2: float, rate: float) -> Tree:
    """One tree by second-order gains over histograms."""
    tree = Tree([], [], [], [], [])

    def node(rows: np.ndarray, level: int) -> int:
        k = len(tree.feature)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for values, start in ((tree.feature, -1), (tree.threshold, 0.0), (tree.left, -1), (tree.right, -1), (tree.value, -rate * total_g / (total_h + l2))):
            values.append(start)
        if level == depth or len(rows) < 2 * least:
            return k
        best = (1e-6, -1, -1)
        for f, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, f]
            cg = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1]
            ch = np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
            n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
            gain = cg**2 / (ch + l2) + (total_g - cg) ** 2 / (total_h - ch + l2) - total_g**2 / (total_h + l2)
            gain[(n < least) | (len(rows) - n < least)] = -1
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], f, i)
        if best[1] >= 0:
            _, f, i = best
            low = binned[rows, f] <= i
            tree.feature[k], tree.threshold[k] = f, float(edges[f][i])
            tree.left[k] = node(rows[low], level + 1)
            tree.right[k] = node(rows[~low], level + 1)
        return k

    node(np.arange(len(g)), 0)
    return tree


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, least: int = 8, l2: float = 1.0, bins: int = 48) -> tuple[float, list[Tree]]:
    """Base score and trees of a logistic boosting model."""
    p = min(max(float(y.mean()), 1e-4), 1 - 1e-4) if len(y) else 0.5
    base = float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return base, []
    edges = edges_of(x, bins)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    z, trees = np.full(len(y), base), []
    for _ in range(rounds):
        q = sigmoid(z)
        tree = grow(binned, edges, q - y, q * (1 - q), depth, least, l2, rate)
        trees.append(tree)
        z += tree.predict(x)
    return base, trees


def raw_score(model: tuple[float, list[Tree]], x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model[0])
    for tree in model[1]:
        out += tree.predict(x)
    return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing map from raw scores to frequencies (pool adjacent
    violators); between block centres it is interpolated."""
    if not len(raw):
        return np.array([0.0]), np.array([0.5])
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # weight, sum of y, sum of raw
    for r, v in zip(raw[order], y[order]):
        blocks.append([1.0, float(v), float(r)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    centres = np.array([b[2] / b[0] for b in blocks])
    heights = np.array([(b[1] + 0.5 * 0.02) / (b[0] + 0.02) for b in blocks])
    return centres, np.maximum.accumulate(heights)


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, **how) -> np.ndarray:
    """Raw scores of each row by a model that hasn't seen its fold."""
    out = np.zeros(len(y))
    for k in np.unique(fold):
        out[fold == k] = raw_score(boost(x[fold != k], y[fold != k], **how), x[fold == k])
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise mean log loss + penalty * |weights|
    (accelerated proximal gradient; the intercept isn't penalised)."""
    n, m = a.shape
    centre = a.mean(axis=0)
    c = a - centre
    top = 1.0
    v = np.ones(m)
    for _ in range(20):  # largest eigenvalue of c'c / n
        v = c.T @ (c @ v) / n
        top = float(np.linalg.norm(v)) or 1.0
        v /= top
    step = 1 / (0.25 * max(top, 1.0) * 1.05)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-4) / (1 - y.mean() + 1e-4)))
    wz, bz, t = w.copy(), b, 1.0
    for _ in range(steps):
        e = sigmoid(c @ wz + bz) - y
        w2 = wz - step * (c.T @ e / n)
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = bz - step * e.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wz, bz = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b - float(centre @ w)
