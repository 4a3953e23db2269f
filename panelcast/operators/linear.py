"""Linear models from moments: one aggregation for all folds, then small solves."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.solve import ridge_from_moments
from .splits import fold_sums


def complete_case(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def through_origin(assigned: DataFrame, x: str) -> DataFrame:
    """``slope`` of y = slope * x per fold."""
    ok = complete_case([x, "y"])
    sums = fold_sums(assigned.where(ok), {"_xy": F.col(x) * F.col("y"), "_xx": F.col(x) * F.col(x)})
    return sums.select(
        "series_id", "protocol", "fold", F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx")).alias("slope")
    )


def two_driver_ols(assigned: DataFrame, x1: str, x2: str) -> DataFrame:
    """``b0, b1, b2`` of ordinary least squares per fold, in closed form.

    NULL when the two drivers are collinear in the training rows.
    """
    a, b, y = F.col(x1), F.col(x2), F.col("y")
    m = fold_sums(
        assigned.where(complete_case([x1, x2, "y"])),
        {
            "n": F.lit(1.0), "a": a, "b": b, "y": y,
            "aa": a * a, "ab": a * b, "bb": b * b, "ay": a * y, "by": b * y,
        },
    )
    c = lambda p, u, v: F.col(p) - F.col(u) * F.col(v) / F.col("n")
    saa, sab, sbb = c("aa", "a", "a"), c("ab", "a", "b"), c("bb", "b", "b")
    say, sby = c("ay", "a", "y"), c("by", "b", "y")
    det = saa * sbb - sab * sab
    ok = det > 1e-9 * saa * sbb
    return (
        m.withColumn("b1", F.when(ok, (say * sbb - sby * sab) / det))
        .withColumn("b2", F.when(ok, (sby * saa - say * sab) / det))
        .withColumn("b0", (F.col("y") - F.col("b1") * F.col("a") - F.col("b2") * F.col("b")) / F.col("n"))
        .select("series_id", "protocol", "fold", "b0", "b1", "b2")
    )


def moment_sums(features: Sequence[str], y: str = "y", weight: Column | None = None) -> dict[str, Column]:
    w = F.lit(1.0) if weight is None else weight
    out = {"n": w, "sy": w * F.col(y)}
    for i, f in enumerate(features):
        out[f"sx{i}"] = w * F.col(f)
        out[f"sxy{i}"] = w * F.col(f) * F.col(y)
        for j in range(i, len(features)):
            out[f"sxx{i}_{j}"] = w * F.col(f) * F.col(features[j])
    return out


def pack_moments(sums: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    full = [F.col(f"sxx{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)]
    return sums.select(
        *keys,
        "n",
        "sy",
        F.array(*[f"sx{i}" for i in range(k)]).alias("sx"),
        F.array(*[f"sxy{i}" for i in range(k)]).alias("sxy"),
        F.array(*full).alias("sxx"),
    )


def ridge_solver(alpha: float, standardise: bool):
    """Pandas UDF over one moment row per model: ``[intercept, slopes...]``."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(n: pd.Series, sx: pd.Series, sxx: pd.Series, sy: pd.Series, sxy: pd.Series) -> pd.Series:
        out = []
        for c, x, xx, t, xy in zip(n, sx, sxx, sy, sxy):
            if c is None or not c > 0:
                out.append(None)
                continue
            x = np.asarray(x, float)
            icept, beta = ridge_from_moments(
                c, x, np.asarray(xx, float).reshape(len(x), len(x)), t, np.asarray(xy, float), alpha, standardise
            )
            out.append([icept, *beta])
        return pd.Series(out)

    return solve


def ridge(
    assigned: DataFrame,
    features: Sequence[str],
    alpha: float = 1.0,
    by: dict[str, Column] | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """``coef`` per fold (and per extra key): ridge on standardised features with an
    unpenalised intercept, returned for the raw features."""
    by = by or {}
    keys = ["series_id", "protocol", "fold", *by]
    ok = assigned.where(complete_case([*features, "y"]))
    packed = pack_moments(fold_sums(ok, moment_sums(features, weight=weight), by), len(features), keys)
    return packed.select(
        *keys,
        F.col("n").alias("n_train"),
        ridge_solver(alpha, True)("n", "sx", "sxx", "sy", "sxy").alias("coef"),
    )


def fit_together(assigned: DataFrame, features: Sequence[str], pair: tuple[str, str], with_ridge: bool = True) -> DataFrame:
    """Through-origin slope, two-driver OLS and ridge per fold from one pass over the rows.

    ``pair`` must be among ``features``; the slope belongs to its first column.
    """
    features = list(features)
    i, j = features.index(pair[0]), features.index(pair[1])
    keys = ["series_id", "protocol", "fold"]
    m = pack_moments(
        fold_sums(assigned.where(complete_case([*features, "y"])), moment_sums(features)), len(features), keys
    )
    k = len(features)
    sx = lambda a: F.get("sx", F.lit(a))
    c = lambda a, b: F.get("sxx", F.lit(a * k + b)) - sx(a) * sx(b) / F.col("n")
    cy = lambda a: F.get("sxy", F.lit(a)) - sx(a) * F.col("sy") / F.col("n")
    det = c(i, i) * c(j, j) - c(i, j) * c(i, j)
    ok = det > 1e-9 * c(i, i) * c(j, j)
    xx = F.get("sxx", F.lit(i * k + i))
    out = (
        m.withColumn("slope", F.when(xx > 0, F.get("sxy", F.lit(i)) / xx))
        .withColumn("b1", F.when(ok, (cy(i) * c(j, j) - cy(j) * c(i, j)) / det))
        .withColumn("b2", F.when(ok, (cy(j) * c(i, i) - cy(i) * c(i, j)) / det))
        .withColumn("b0", (F.col("sy") - F.col("b1") * sx(i) - F.col("b2") * sx(j)) / F.col("n"))
    )
    coef = [ridge_solver(1.0, True)("n", "sx", "sxx", "sy", "sxy").alias("coef")] if with_ridge else []
    return out.select(*keys, "slope", "b0", "b1", "b2", *coef)


def linear_value(features: Sequence[str], coef: str = "coef") -> Column:
    """Prediction from a coefficient array, floored at 0."""
    out = F.get(coef, F.lit(0))
    for i, f in enumerate(features):
        out = out + F.get(coef, F.lit(i + 1)) * F.col(f)
    return F.when(out.isNotNull(), F.greatest(out, F.lit(0.0)))
