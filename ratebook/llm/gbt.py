"""Small histogram gradient boosting with monotonic constraints, flattened into node arrays.

Every tree is complete, of one depth, so a forest is four numpy arrays and
scoring a batch is ``depth`` gathers per tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Forest:
    """feature and threshold: trees x inner nodes; value: trees x leaves; base: log odds."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _best_split(hist_g, hist_h, sign, lo, hi, ridge, least):
    """Best bin of one feature: (gain, bin, left value, right value)."""
    g_left, h_left = np.cumsum(hist_g)[:-1], np.cumsum(hist_h)[:-1]
    g, h = hist_g.sum(), hist_h.sum()
    left = np.clip(-g_left / (h_left + ridge), lo, hi)
    right = np.clip(-(g - g_left) / (h - h_left + ridge), lo, hi)
    whole = np.clip(-g / (h + ridge), lo, hi)
    gain = (-(g_left * left + 0.5 * (h_left + ridge) * left ** 2)
            - ((g - g_left) * right + 0.5 * (h - h_left + ridge) * right ** 2)
            + (g * whole + 0.5 * (h + ridge) * whole ** 2))
    bad = (h_left < least) | (h - h_left < least)
    if sign:
        bad |= sign * (right - left) < 0
    gain = np.where(bad, -np.inf, gain)
    k = int(np.argmax(gain))
    return gain[k], k, left[k], right[k]


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2,
        ridge: float = 1.0, least: float = 2.0) -> Forest:
    """Logistic boosting; ``monotone`` holds -1, 0 or 1 per feature (the sign the margin must follow)."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    inner, leaves = 2 ** depth - 1, 2 ** depth
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        bounds = {0: (-np.inf, np.inf)}
        worth = {0: float(-grad.sum() / (hess.sum() + ridge))}
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            lo, hi = bounds[k]
            best = (1e-6, -1, 0, 0.0, 0.0)
            if len(rows):
                for f in range(width):
                    if len(cuts[f]) == 0:
                        continue
                    bins = len(cuts[f]) + 1
                    hg = np.bincount(binned[rows, f], weights=grad[rows], minlength=bins)
                    hh = np.bincount(binned[rows, f], weights=hess[rows], minlength=bins)
                    gain, b, left, right = _best_split(hg, hh, monotone[f], lo, hi, ridge, least)
                    if gain > best[0]:
                        best = (gain, f, b, left, right)
            _, f, b, left, right = best
            if f < 0:  # no split: everything goes left, both sides keep the node's value
                left = right = worth[k]
                node[rows] = 2 * k + 1
                sides = ((lo, hi), (lo, hi))
            else:
                feature[t, k], threshold[t, k] = f, cuts[f][b]
                node[rows] = 2 * k + 1 + (binned[rows, f] > b)
                middle = (left + right) / 2
                sides = {1: ((lo, middle), (middle, hi)), -1: ((middle, hi), (lo, middle))}.get(
                    int(monotone[f]), ((lo, hi), (lo, hi)))
            bounds[2 * k + 1], bounds[2 * k + 2] = sides
            worth[2 * k + 1], worth[2 * k + 2] = left, right
        value[t] = rate * np.array([worth[inner + i] for i in range(leaves)])
        margin += value[t][node - inner]
    return Forest(feature, threshold, value, base)
