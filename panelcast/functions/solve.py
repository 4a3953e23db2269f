"""Small dense solves on moment matrices: ridge, NNLS and simplex least squares.

Input size is the number of model members or features, never the number of rows.
"""

from __future__ import annotations

import numpy as np


def ridge_from_moments(
    n: float, sx: np.ndarray, sxx: np.ndarray, sy: float, sxy: np.ndarray, alpha: float, standardise: bool
) -> tuple[float, np.ndarray]:
    """Intercept and slopes of ridge with an unpenalised intercept, in raw units."""
    mean = sx / n
    cxx = sxx - n * np.outer(mean, mean)
    cxy = sxy - mean * sy
    sd = np.sqrt(np.maximum(np.diag(cxx) / n, 0.0)) if standardise else np.ones(len(sx))
    # a column whose spread is rounding noise counts as constant
    flat = sd <= 1e-9 * np.maximum(np.abs(mean), 1e-12) if standardise else np.zeros(len(sx), bool)
    scale = np.where(flat, 1.0, sd)
    a = cxx / np.outer(scale, scale) + alpha * np.eye(len(sx))
    b = cxy / scale
    b[flat] = 0.0
    a[flat, :] = 0.0
    a[:, flat] = 0.0
    a[flat, flat] = 1.0
    w = np.linalg.lstsq(a, b, rcond=None)[0] if alpha == 0 else np.linalg.solve(a, b)
    beta = w / scale
    return float(sy / n - beta @ mean), beta


def nnls_from_gram(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """min ||Aw - b|| with w >= 0 given G = A'A and h = A'b, by active sets."""
    k = len(h)
    norm = np.sqrt(np.maximum(np.diag(g), 0.0))
    live = norm > 0
    s = np.where(live, norm, 1.0)
    q, r = g / np.outer(s, s), h / s
    w, free = np.zeros(k), np.zeros(k, bool)
    tol = 1e-12 * max(1.0, float(np.abs(r).max(initial=0.0)))
    for _ in range(30 * k):
        grad = r - q @ w
        cand = ~free & live & (grad > tol)
        if not cand.any():
            break
        free[np.argmax(np.where(cand, grad, -np.inf))] = True
        while free.any():
            z = np.zeros(k)
            idx = np.flatnonzero(free)
            z[idx] = np.linalg.lstsq(q[np.ix_(idx, idx)], r[idx], rcond=None)[0]
            if (z[idx] > 0).all():
                w = z
                break
            bad = free & (z <= 0)
            step = np.min(w[bad] / np.maximum(w[bad] - z[bad], 1e-300))
            w = w + step * (z - w)
            free &= w > 1e-15
            w[~free] = 0.0
    return w / s


def simplex_from_gram(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """min ||Aw - b|| with w >= 0 and sum(w) = 1, by active sets on the KKT system."""
    k = len(h)
    scale = max(float(np.abs(g).max(initial=0.0)), 1e-300)
    q, r = g / scale, h / scale
    start = int(np.argmin(np.diag(q) - 2 * r))
    w = np.zeros(k)
    w[start] = 1.0
    free = w > 0
    for _ in range(30 * k):
        while True:
            idx = np.flatnonzero(free)
            m = len(idx)
            kkt = np.zeros((m + 1, m + 1))
            kkt[:m, :m] = q[np.ix_(idx, idx)]
            kkt[:m, m] = kkt[m, :m] = 1.0
            sol = np.linalg.lstsq(kkt, np.append(r[idx], 1.0), rcond=None)[0]
            z = np.zeros(k)
            z[idx] = sol[:m]
            if (z[idx] >= -1e-14).all():
                w = np.maximum(z, 0.0)
                lam = sol[m]
                break
            bad = free & (z < 0)
            step = np.min(w[bad] / np.maximum(w[bad] - z[bad], 1e-300))
            w = w + step * (z - w)
            free &= w > 1e-15
        slack = q @ w - r + lam
        cand = ~free & (slack < -1e-10)
        if not cand.any():
            break
        free[np.argmin(np.where(cand, slack, np.inf))] = True
    return w / w.sum()
