"""Gradient-boosted trees for two classes over dense features, and isotonic calibration, in numpy.

Fitted on the driver over a sample of bounded size; a fitted model is a few arrays, and is applied by the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth: at each inner node a feature and a threshold, at each leaf a value."""

    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**self.depth - 1)]
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 4.0, ridge: float = 2.0, weight: np.ndarray | None = None) -> Trees:
    """Newton boosting of the logistic loss over histograms of at most `bins` quantiles a feature; least: hessian in a leaf."""
    n, m = x.shape
    w = np.ones(n) if weight is None else weight
    mean = np.clip((w @ y + 1) / (w.sum() + 2), 1e-4, 1 - 1e-4)
    start = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if n else np.zeros((0, m), np.int64)
    width = bins + 1
    inner = 2**depth - 1
    margin = np.full(n, start)
    features, thresholds, leaves = [], [], []
    for _ in range(trees if n else 0):
        p = sigmoid(margin)
        g, h = w * (y - p), w * p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best_gain, best_feature, best_cut = np.full(count, 1e-6), np.zeros(count, np.int64), np.full(count, -1)
            for j in range(m):
                if not len(cuts[j]):
                    continue
                key = local * width + code[:, j]
                gs = np.cumsum(np.bincount(key, g, count * width).reshape(count, width), axis=1)
                hs = np.cumsum(np.bincount(key, h, count * width).reshape(count, width), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = -1
                gain[:, len(cuts[j]) :] = -1
                at = gain.argmax(axis=1)
                value = gain[np.arange(count), at]
                better = value > best_gain
                best_gain[better], best_feature[better], best_cut[better] = value[better], j, at[better]
            for k in range(count):
                if best_cut[k] >= 0:
                    feature[first + k], threshold[first + k] = best_feature[k], cuts[best_feature[k]][best_cut[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        local = node - inner
        gs, hs = np.bincount(local, g, 2**depth), np.bincount(local, h, 2**depth)
        leaf = rate * gs / (hs + ridge)
        margin += leaf[local]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(depth, np.array(features).reshape(-1, inner), np.array(thresholds).reshape(-1, inner), np.array(leaves).reshape(-1, 2**depth), start)


@dataclass
class Isotonic:
    """A rising piecewise linear map from margins to probabilities."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.x, self.y) if len(self.x) else sigmoid(margin)


def fit_isotonic(margin: np.ndarray, y: np.ndarray, weight: float = 1.0) -> Isotonic:
    """Pool adjacent violators; each block's probability, drawn a little to the middle, stands at its mean margin."""
    if not len(y) or y.min() == y.max():
        return Isotonic(np.zeros(0), np.zeros(0))
    order = np.argsort(margin, kind="stable")
    stack: list[list[float]] = []
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        stack.append([v, 1.0, m])
        while len(stack) > 1 and stack[-2][0] / stack[-2][1] >= stack[-1][0] / stack[-1][1]:
            top = stack.pop()
            stack[-1] = [a + b for a, b in zip(stack[-1], top, strict=True)]
    mean = float(y.mean())
    x = np.array([s[2] / s[1] for s in stack])
    p = np.array([(s[0] + weight * mean) / (s[1] + weight) for s in stack])
    return Isotonic(x, np.maximum.accumulate(p))


@dataclass
class Logistic:
    """A logistic regression over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weight + self.bias


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> Logistic:
    """Newton steps on the penalised logistic loss."""
    m = x.shape[1]
    if not len(y):
        return Logistic(np.zeros(m), np.ones(m), np.zeros(m), 0.0)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(m + 1)
    penalty = np.append(np.full(m, ridge), 1e-3)
    for _ in range(steps):
        p = sigmoid(z @ w)
        grad = z.T @ (y - p) - penalty * w
        hess = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w[:-1], float(w[-1]))
