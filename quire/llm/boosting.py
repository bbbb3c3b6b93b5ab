"""Gradient-boosted trees on a bounded sample, scored as flat numpy arrays.

Logistic loss, features cut at quantiles, trees grown level by level on gradient
histograms. ``monotone`` gives a sign per feature: a split that would break it is
not taken, and each side keeps the bound (the middle of the two leaf values) for
all that grows below it, so the score never moves against the sign.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Forest:
    """Complete trees of one depth: ``feature``/``threshold`` trees x (2^depth - 1)
    inner nodes (breadth first; a closed node has feature 0 and threshold +inf),
    ``leaf`` trees x 2^depth values."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row of ``x``."""
        depth = int(np.log2(self.leaf.shape[1]))
        out = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (len(leaf) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.score(x), -60, 60)))


def train(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, smooth: float = 1.0) -> Forest:
    n, m = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0:
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    share = (y.sum() + 1) / (n + 2)
    prior = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)  # code <= b  <=>  x <= cut b
    score = np.full(n, prior)
    forest: tuple[list, list, list] = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        low, high = np.full(inner + leaves, -np.inf), np.full(inner + leaves, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            for j in range(width):
                k = first + j
                here = np.flatnonzero(node == k)
                low[[2 * k + 1, 2 * k + 2]], high[[2 * k + 1, 2 * k + 2]] = low[k], high[k]
                best = _split(code[here], g[here], h[here], cuts, monotone, low[k], high[k], smooth)
                right = np.zeros(len(here), bool)
                if best is not None:
                    f, b, left_value, right_value = best
                    feature[k], threshold[k] = f, cuts[f][b]
                    right = code[here, f] > b
                    middle = (left_value + right_value) / 2
                    if monotone[f] > 0:
                        high[2 * k + 1], low[2 * k + 2] = min(high[k], middle), max(low[k], middle)
                    elif monotone[f] < 0:
                        low[2 * k + 1], high[2 * k + 2] = max(low[k], middle), min(high[k], middle)
                node[here] = 2 * k + 1 + right
        place = node - inner
        sums = np.bincount(place, weights=g, minlength=leaves), np.bincount(place, weights=h, minlength=leaves)
        leaf = rate * np.clip(sums[0] / (sums[1] + smooth), low[inner:], high[inner:])
        score += leaf[place]
        for out, made in zip(forest, (feature, threshold, leaf)):
            out.append(made)
    return Forest(*(np.array(a) for a in forest), prior)


def _split(code, g, h, cuts, monotone, low, high, smooth):
    """The split of most gain: feature, bin, value left, value right."""
    best, most = None, 1e-6
    for f, c in enumerate(cuts):
        if not len(c) or len(g) < 4:
            continue
        gl = np.cumsum(np.bincount(code[:, f], weights=g, minlength=len(c) + 1))
        hl = np.cumsum(np.bincount(code[:, f], weights=h, minlength=len(c) + 1))
        gr, hr = gl[-1] - gl[:-1], hl[-1] - hl[:-1]
        gl_, hl_ = gl[:-1], hl[:-1]
        left, right = np.clip(gl_ / (hl_ + smooth), low, high), np.clip(gr / (hr + smooth), low, high)
        value = lambda a, s, w: 2 * a * s - a * a * (w + smooth)
        whole = np.clip(gl[-1] / (hl[-1] + smooth), low, high)
        gain = value(left, gl_, hl_) + value(right, gr, hr) - value(whole, gl[-1], hl[-1])
        if monotone[f]:
            gain = np.where(monotone[f] * (right - left) >= 0, gain, -np.inf)
        gain = np.where((hl_ > 0) & (hr > 0), gain, -np.inf)
        b = int(np.argmax(gain))
        if gain[b] > most:
            best, most = (f, b, float(left[b]), float(right[b])), float(gain[b])
    return best
