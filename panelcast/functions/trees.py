"""Boosted regression trees over binned features, for models that fit in a task.

A model of one series and fold has at most as many rows as the grid has slots, whatever
the size of the log, so a task holds it as small integers. Trees grow best leaf first
from histograms of residuals; a child's histogram is its parent's less its sibling's.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosting:
    """Fitting stops when ``patience`` rounds brought no better error on the rows held out."""

    rounds: int = 800
    rate: float = 0.04
    depth: int = 8
    leaves: int = 31
    min_leaf: int = 30
    penalty: float = 0.1
    patience: int = 25
    held: float = 0.12
    bins: int = 255


def edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Upper edges of the bins of one feature, from its finite values."""
    known = np.unique(x[np.isfinite(x)])
    if len(known) > bins:
        known = np.unique(np.quantile(x[np.isfinite(x)], np.arange(1, bins) / bins, method="midpoint"))
        return known
    return (known[:-1] + known[1:]) / 2


class Binned:
    """Rows as bin numbers; a missing value has the last number of its feature."""

    def __init__(self, x: np.ndarray, train: np.ndarray, bins: int):
        cuts = [edges(x[train, f], bins) for f in range(x.shape[1])]
        self.width = max((len(c) for c in cuts), default=0) + 2
        self.features = x.shape[1]
        self.codes = np.empty(x.shape, dtype=np.intp)  # bin by bin, so that running sums go over whole rows of features
        for f, c in enumerate(cuts):
            self.codes[:, f] = np.where(np.isfinite(x[:, f]), np.searchsorted(c, x[:, f], side="left"), self.width - 1) * self.features + f

    def histogram(self, rows: np.ndarray, residual: np.ndarray) -> np.ndarray:
        """Sums of residuals and numbers of rows by bin and feature."""
        codes = self.codes[rows].ravel()
        out = np.empty((2, self.features * self.width))
        out[0] = np.bincount(codes, weights=np.repeat(residual[rows], self.features), minlength=out.shape[1])
        out[1] = np.bincount(codes, minlength=out.shape[1])
        return out.reshape(2, self.width, self.features)


def best_split(hist: np.ndarray, o: Boosting) -> tuple[float, int, int, bool] | None:
    """(gain, feature, last bin on the left, missing values go left) or None."""
    all_sum, all_count = hist[:, :, 0].sum(axis=1)
    known = hist[:, :-1].cumsum(axis=1)
    best = None
    for left in (False, True):
        if left:
            if not hist[1, -1].any():
                break
            known += hist[:, -1:]
        s, n = known
        rest = all_count - n
        gain, other = s * s, all_sum - s
        gain /= np.maximum(n, 1) + o.penalty
        other *= other
        other /= np.maximum(rest, 1) + o.penalty
        gain += other
        gain[np.minimum(n, rest) < o.min_leaf] = -np.inf
        at = int(gain.argmax())
        value = float(gain.flat[at] - all_sum * all_sum / (all_count + o.penalty))
        if value > 1e-12 and (best is None or value > best[0]):
            best = (value, at % gain.shape[1], at // gain.shape[1], left)
    return best


def grow(binned: Binned, rows: np.ndarray, residual: np.ndarray, every: np.ndarray, step: np.ndarray, o: Boosting) -> bool:
    """One tree grown on ``rows``; adds its (shrunken) values to ``step`` for the rows ``every``.
    Whether the tree has a split."""
    leaf_of = {}
    queue: list = []

    def open_leaf(number, own, others, depth, hist):
        leaf_of[number] = (own, others)
        found = best_split(hist, o) if depth < o.depth and len(own) >= 2 * o.min_leaf else None
        if found:
            heapq.heappush(queue, (-found[0], number, depth, found, hist))

    open_leaf(0, rows, every, 0, binned.histogram(rows, residual))
    numbers, split = 0, bool(queue)
    while queue and len(leaf_of) < o.leaves:
        _, number, depth, (_, feature, last, missing_left), hist = heapq.heappop(queue)
        own, others = leaf_of.pop(number)
        low, high = (n * binned.features + feature for n in (last, binned.width - 1))

        def goes_left(which):
            code = binned.codes[which, feature]
            return (code <= low) | (code == high) if missing_left else code <= low

        here, there = goes_left(own), goes_left(others)
        a, b = own[here], own[~here]
        small = binned.histogram(a if len(a) <= len(b) else b, residual)
        large = hist - small
        first, second = (small, large) if len(a) <= len(b) else (large, small)
        open_leaf(numbers + 1, a, others[there], depth + 1, first)
        open_leaf(numbers + 2, b, others[~there], depth + 1, second)
        numbers += 2
    for own, others in leaf_of.values():
        step[others] = o.rate * residual[own].sum() / (len(own) + o.penalty)
    return split


def boost(x: np.ndarray, y: np.ndarray, train: np.ndarray, held: np.ndarray, o: Boosting) -> np.ndarray:
    """Forecasts of all rows of ``x``. Trees are fitted to ``y`` on the rows ``train`` but not
    ``held``; bins come from all training rows. Without training rows all forecasts are 0."""
    fit = np.flatnonzero(train & ~held)
    stop = np.flatnonzero(train & held)
    if not len(fit):
        fit, stop = stop, fit
    if not len(fit):
        return np.zeros(len(x))
    binned = Binned(x, train, o.bins)
    every, value, step = np.arange(len(x)), np.full(len(x), y[fit].mean()), np.zeros(len(x))
    errors: list[float] = []
    for _ in range(o.rounds):
        if not grow(binned, fit, y - value, every, step, o):
            break
        value += step
        if len(stop):
            errors.append(float(((y[stop] - value[stop]) ** 2).mean()) / 2)
            if len(errors) > o.patience and min(errors[-o.patience :]) > errors[-o.patience - 1] - 1e-7:
                break
    return value
