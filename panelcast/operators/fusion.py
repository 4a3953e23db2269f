"""Forecast fusion with weights fitted on validation rows.

All weights come from one aggregate per (series, protocol, fold): the members'
Gram matrix. Only that K x K matrix reaches a solver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.solve import nnls_from_gram, ridge_from_moments, simplex_from_gram

FOLD = ("series_id", "protocol", "fold")
VARIANTS = ("Mean", "InvRMSE", "RidgeStack", "NNLSStack", "BestSingleByVal")


def gram(rows: DataFrame, members: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``keys, n, sy, syy, s, h, g``: counts, sums, A'b and A'A as arrays."""
    k = len(members)
    m = [F.col(c) for c in members]
    sums = [F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")]
    for i in range(k):
        sums.append(F.sum(m[i]).alias(f"_s{i}"))
        sums.append(F.sum(m[i] * F.col("y")).alias(f"_h{i}"))
        sums.append(F.sum((F.col("y") - m[i]) * (F.col("y") - m[i])).alias(f"_e{i}"))
        sums += [F.sum(m[i] * m[j]).alias(f"_g{i}_{j}") for j in range(i, k)]
    arr = lambda f: F.array(*[F.col(f(i)) for i in range(k)])
    return rows.groupBy(*keys).agg(*sums).select(
        *keys,
        "n",
        "sy",
        "syy",
        arr(lambda i: f"_s{i}").alias("s"),
        arr(lambda i: f"_h{i}").alias("h"),
        arr(lambda i: f"_e{i}").alias("sse"),
        F.array(*[F.col(f"_g{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)]).alias("g"),
    )


def validation_rows(wide: DataFrame) -> DataFrame:
    return wide.where((F.col("role") == "val") & F.col("active") & ~F.col("is_missing"))


def _matrix(g, k: int) -> np.ndarray:
    return np.asarray(g, float).reshape(k, k)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def nnls_weights(g: pd.Series, h: pd.Series) -> pd.Series:
    """Equal weights where the solution vanishes."""
    out = []
    for gi, hi in zip(g, h):
        hi = np.asarray(hi, float)
        w = nnls_from_gram(_matrix(gi, len(hi)), hi)
        out.append((w if w.sum() > 1e-6 else np.full(len(hi), 1.0 / len(hi))).tolist())
    return pd.Series(out)


def total(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)


def sum_to_one(weights: Column) -> Column:
    return F.transform(weights, lambda x: x / total(weights))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def simplex_weights(g: pd.Series, h: pd.Series) -> pd.Series:
    return pd.Series(
        [simplex_from_gram(_matrix(gi, len(hi)), np.asarray(hi, float)).tolist() for gi, hi in zip(g, h)]
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def ridge_stack(n: pd.Series, s: pd.Series, g: pd.Series, sy: pd.Series, h: pd.Series) -> pd.Series:
    """``[intercept, weights...]`` with alpha = 1 on unscaled members."""
    out = []
    for ni, si, gi, yi, hi in zip(n, s, g, sy, h):
        si = np.asarray(si, float)
        icept, w = ridge_from_moments(float(ni), si, _matrix(gi, len(si)), yi, np.asarray(hi, float), 1.0, False)
        out.append([icept, *w])
    return pd.Series(out)


def inverse_rmse(sse: Column, n: Column) -> Column:
    """Normalised inverse RMSE per member; perfect members share all the weight."""
    return sum_to_one(F.transform(sse, lambda e: 1.0 / F.greatest(F.sqrt(e / n), F.lit(1e-12))))


def lowest(sse: Column) -> Column:
    """0-based position of the first smallest element."""
    return (F.array_position(sse, F.array_min(sse)) - 1).cast("int")


def fit(wide: DataFrame, members: Sequence[str], keys: Sequence[str] = FOLD) -> DataFrame:
    """One row per key with the weights of every variant."""
    m = gram(validation_rows(wide), members, keys)
    solved = m.select(
        "*",
        ridge_stack("n", "s", "g", "sy", "h").alias("w_ridge"),
        nnls_weights("g", "h").alias("w_nnls"),
        simplex_weights("g", "h").alias("w_simplex"),
    )
    return solved.select(
        *keys,
        F.col("n").alias("n_val"),
        inverse_rmse(F.col("sse"), F.col("n")).alias("w_inv"),
        "w_ridge",
        "w_nnls",
        sum_to_one(F.col("w_nnls")).alias("w_nnls_sum1"),
        "w_simplex",
        lowest(F.col("sse")).alias("best_member"),
    )


def _dot(weights: str, members: Sequence[str], start: int = 0) -> Column:
    out = F.lit(0.0)
    for i, m in enumerate(members):
        out = out + F.get(weights, F.lit(i + start)) * F.col(m)
    return out


def mean_of(members: Sequence[str]) -> Column:
    return sum((F.col(m) for m in members[1:]), F.col(members[0])) / float(len(members))


def apply(wide: DataFrame, weights: DataFrame, members: Sequence[str], keys: Sequence[str] = FOLD) -> DataFrame:
    """Fused forecasts on test rows; a fold without validation rows gets the mean."""
    rows = wide.where(F.col("role") == "test").join(weights, list(keys), "left")
    mean = mean_of(members)
    has = F.col("n_val") > 0
    or_mean = lambda c: F.when(has, c).otherwise(mean)
    floor = lambda c: F.greatest(c, F.lit(0.0))
    best = F.get(F.array(*members), F.col("best_member"))
    return rows.withColumns(
        {
            "Mean": mean,
            "InvRMSE": or_mean(_dot("w_inv", members)),
            "RidgeStack": or_mean(floor(F.get("w_ridge", F.lit(0)) + _dot("w_ridge", members, 1))),
            "NNLSStack": or_mean(floor(_dot("w_nnls", members))),
            "NNLSRenormalised": or_mean(floor(_dot("w_nnls_sum1", members))),
            "NNLSConvex": or_mean(floor(_dot("w_simplex", members))),
            "BestSingleByVal": or_mean(best),
        }
    ).drop("n_val", "w_inv", "w_ridge", "w_nnls", "w_nnls_sum1", "w_simplex", "best_member")


def per_hour_stack(wide: DataFrame, members: Sequence[str], min_rows: int = 8) -> DataFrame:
    """NNLS weights per hour of day, scaled to sum 1; equal weights below ``min_rows``.

    The hour is the row's real hour, so holes do not shift it.
    """
    k = len(members)
    keys = [*FOLD, "_h"]
    rows = validation_rows(wide).withColumn("_h", F.hour("ts"))
    equal = F.array_repeat(F.lit(1.0 / k), k)
    w = gram(rows, members, keys).select("*", nnls_weights("g", "h").alias("_nnls")).select(
        *keys, F.when(F.col("n") >= min_rows, sum_to_one(F.col("_nnls"))).otherwise(equal).alias("_w")
    )
    test = wide.where(F.col("role") == "test").withColumn("_h", F.hour("ts"))
    fused = F.when(F.col("_w").isNull(), mean_of(members)).otherwise(_dot("_w", members))
    return (
        test.join(w, keys, "left")
        .withColumn("PerHourStack", F.greatest(fused, F.lit(0.0)))
        .drop("_w", "_h")
    )


def weight_shares(weights: DataFrame, members: Sequence[str], col: str = "w_nnls", keys: Sequence[str] = ("series_id", "protocol")) -> DataFrame:
    """Mean and sd over folds of each member's share, and the mean raw sum."""
    names = F.array(*[F.lit(m) for m in members])
    rows = weights.withColumn("_total", total(F.col(col))).select(
        *keys, "_total", F.inline(F.arrays_zip(names.alias("member"), F.col(col).alias("w")))
    )
    share = F.col("w") / F.col("_total")
    return rows.groupBy(*keys, "member").agg(
        F.avg(share).alias("share_mean"),
        F.stddev_samp(share).alias("share_sd"),
        F.avg("_total").alias("sum_mean"),
        F.count("*").alias("n_folds"),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _leave_out_sse(g: pd.Series, h: pd.Series, og: pd.Series, oh: pd.Series, oyy: pd.Series) -> pd.Series:
    """Squared error on the own fold with weights of the other folds: all members,
    then without each one."""
    out = []
    for gi, hi, go, ho, yy in zip(g, h, og, oh, oyy):
        hi, ho = np.asarray(hi, float), np.asarray(ho, float)
        k = len(hi)
        gi, go = _matrix(gi, k), _matrix(go, k)
        row = []
        for drop in [None, *range(k)]:
            keep = np.array([i for i in range(k) if i != drop])
            w = nnls_from_gram(gi[np.ix_(keep, keep)], hi[keep])
            w = w / w.sum() if w.sum() > 0 else np.full(len(keep), 1.0 / len(keep))
            q = go[np.ix_(keep, keep)]
            row.append(float(max(yy - 2.0 * w @ ho[keep] + w @ q @ w, 0.0)))
        out.append(row)
    return pd.Series(out)


def leave_member_out(wide: DataFrame, members: Sequence[str], keys: Sequence[str] = ("series_id", "protocol")) -> DataFrame:
    """RMSE increase when a member is dropped, weights fitted on the other folds.

    Moments of "the other folds" are the total minus the fold's own, so the
    forecasts are read once whatever the number of folds and members.
    """
    k = len(members)
    keys = list(keys)
    rows = wide.where((F.col("role") == "test") & F.col("active") & ~F.col("is_missing"))
    per_fold = gram(rows, members, [*keys, "fold"])
    all_folds = Window.partitionBy(*keys)
    minus = lambda c, size: F.array(
        *[F.sum(F.get(c, F.lit(i))).over(all_folds) - F.get(c, F.lit(i)) for i in range(size)]
    )
    sse = (
        per_fold.withColumns(
            {"_go": minus("g", k * k), "_ho": minus("h", k), "_folds": F.count("*").over(all_folds)}
        )
        .where(F.col("_folds") > 1)
        .withColumn("_sse", _leave_out_sse("_go", "_ho", "g", "h", "syy"))
    )
    names = F.array(*[F.lit(m) for m in ("ALL", *members)])
    scored = (
        sse.select(*keys, "n", F.posexplode("_sse").alias("_i", "_e"))
        .groupBy(*keys, "_i")
        .agg(F.sqrt(F.sum("_e") / F.sum("n")).alias("rmse_without"))
    )
    full = F.max(F.when(F.col("_i") == 0, F.col("rmse_without"))).over(Window.partitionBy(*keys))
    return scored.select(
        *keys,
        F.get(names, F.col("_i")).alias("model"),
        "rmse_without",
        (100.0 * (F.col("rmse_without") - full) / full).alias("rmse_increase_pct"),
    )
