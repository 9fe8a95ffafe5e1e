"""Gradient-boosted trees for two classes, on a bounded sample: shallow trees over quantile bins, logistic loss."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 24, l2: float = 1.0) -> dict:
    """A model of plain arrays: node k of a tree has children 2k+1 and 2k+2."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], axis=1)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin, size = np.full(len(y), start), (1 << (depth + 1)) - 1
    feature, threshold, value = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for k in range(size):
            own = np.flatnonzero(node == k)
            if not len(own):
                continue
            total_g, total_h = g[own].sum(), h[own].sum()
            value[t, k] = rate * total_g / (total_h + l2)
            if 2 * k + 2 >= size or len(own) < 20:
                continue
            best = (1e-6, None, None)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                left_g = np.cumsum(np.bincount(binned[own, j], g[own], minlength=len(c) + 1))[:-1]
                left_h = np.cumsum(np.bincount(binned[own, j], h[own], minlength=len(c) + 1))[:-1]
                gain = left_g**2 / (left_h + l2) + (total_g - left_g) ** 2 / (total_h - left_h + l2) - total_g**2 / (total_h + l2)
                b = int(np.argmax(gain))
                if gain[b] > best[0]:
                    best = (float(gain[b]), j, b)
            if best[1] is not None:
                feature[t, k], threshold[t, k] = best[1], cuts[best[1]][best[2]]
                node[own] = np.where(binned[own, best[1]] <= best[2], 2 * k + 1, 2 * k + 2)
        margin += value[t, node]
    return {"start": start, "depth": depth, "feature": feature, "threshold": threshold, "value": value}


def margins(model: dict, x: np.ndarray) -> np.ndarray:
    """Log odds of each row."""
    out = np.full(len(x), model["start"])
    rows = np.arange(len(x))
    for feature, threshold, value in zip(model["feature"], model["threshold"], model["value"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            f = feature[node]
            node = np.where(f < 0, node, 2 * node + 1 + (x[rows, f] >= threshold[node]))
        out += value[node]
    return out
