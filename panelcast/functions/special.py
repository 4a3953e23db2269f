"""Two-sided Student-t tail as a pandas UDF; meant for one row per comparison."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Continued fraction of the incomplete beta function, modified Lentz."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    f = d.copy()
    for m in range(1, rounds + 1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        f *= c * d
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        step = c * d
        f *= step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return f


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    out = np.full(t.shape, np.nan)
    ok = np.isfinite(t) & (df > 0)
    if not ok.any():
        return out
    t, df = t[ok], df[ok]
    a, b, x = df / 2.0, np.full(t.shape, 0.5), df / (df + t * t)
    lg = np.vectorize(math.lgamma)
    # x**a underflows gracefully; log1p keeps digits when t*t << df
    log_x = -np.log1p(t * t / df)
    log_1x = np.log(np.maximum(t * t / (df + t * t), 1e-300))
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * log_x + b * log_1x)
    direct = x < (a + 1.0) / (a + b + 2.0)
    p = np.where(
        direct,
        front * _beta_fraction(a, b, np.where(direct, x, 0.0)) / a,
        1.0 - front * _beta_fraction(b, a, np.where(direct, 0.0, 1.0 - x)) / b,
    )
    out[ok] = np.where(t == 0.0, 1.0, np.clip(p, 0.0, 1.0))
    return out


@F.pandas_udf(T.DoubleType())
def student_t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    p = t_two_sided(t.to_numpy(dtype=float), df.to_numpy(dtype=float))
    return pd.Series(p).where(np.isfinite(p), None)
