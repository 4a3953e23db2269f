"""Scores of stored forecasts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.chunks import WIDTH, with_neighbours
from ..functions.time import day_of
from .grid import first_per_key


def to_long(wide: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per model; a row-local explode, no shuffle."""
    rest = [c for c in wide.columns if c not in models]
    pairs = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("yhat")) for m in models])
    return wide.select(*rest, F.inline(pairs))


def with_subsets(df: DataFrame, active: str = "active") -> DataFrame:
    """Tag rows for the two overlapping subsets in one pass."""
    tags = F.array_compact(F.array(F.lit("ALL"), F.when(F.col(active), F.lit("active"))))
    return df.withColumn("subset", F.explode(tags))


def observed(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_missing"))


def metric_columns(y: str = "y", yhat: str = "yhat", capacity: Column | None = None) -> list[Column]:
    """One-pass aggregates: n, R2 = 1 - SSE/SST, MAE, RMSE, both in % of capacity.

    Only finite pairs count; with fewer than 5 or a constant target all are NULL.
    """
    a, b = F.col(y), F.col(yhat)
    finite = C.finite(a, b)
    t = F.when(finite, a)
    e = F.when(finite, a - b)
    n = F.count(t)
    var = F.var_pop(t)
    ok = (n >= 5) & (var >= 1e-9)
    mae, rmse = F.avg(F.abs(e)), F.sqrt(F.avg(e * e))
    out = [
        n.alias("n"),
        F.when(ok, 1.0 - F.sum(e * e) / (var * n)).alias("r2"),
        F.when(ok, mae).alias("mae"),
        F.when(ok, rmse).alias("rmse"),
    ]
    if capacity is not None:
        cap = F.max(capacity)
        out += [
            F.when(ok, mae / cap * 100.0).alias("nmae_pct"),
            F.when(ok, rmse / cap * 100.0).alias("nrmse_pct"),
        ]
    return out


def score(pred: DataFrame, keys: Sequence[str], capacity: Column | None = None) -> DataFrame:
    """Metrics per key over observed rows."""
    return observed(pred).groupBy(*keys).agg(*metric_columns(capacity=capacity))


def score_pooled_and_by_fold(pred: DataFrame, capacity: Column | None = None) -> DataFrame:
    """Pooled and per-fold metrics in one job; pooled rows have ``fold`` = 'ALL'."""
    rows = with_subsets(observed(pred)).withColumn("fold", F.explode(F.array("fold", F.lit("ALL"))))
    return rows.groupBy("series_id", "protocol", "fold", "model", "subset").agg(
        *metric_columns(capacity=capacity)
    )


def score_by_month(pred: DataFrame, capacity: Column, min_rows: int = 5) -> DataFrame:
    """Per month for each model, one row per timestamp (the first fold's), small groups dropped."""
    once = first_per_key(
        observed(pred).select("series_id", "protocol", "model", "ts", "fold", "y", "yhat", "active", capacity.alias("_cap")),
        ["series_id", "protocol", "model", "ts"],
        ["fold"],
    )
    return (
        with_subsets(once)
        .groupBy("series_id", "protocol", "model", F.date_format("ts", "yyyy-MM").alias("month"), "subset")
        .agg(*metric_columns(capacity=F.col("_cap")))
        .where(F.col("n") >= min_rows)
    )


def add_skill(metrics: DataFrame, reference: str, keys: Sequence[str], rmse: str = "rmse", name: str = "skill") -> DataFrame:
    """1 - RMSE / RMSE of the reference model in the same group; NULL without a positive one."""
    ref = F.max(F.when(F.col("model") == reference, F.col(rmse))).over(Window.partitionBy(*keys))
    return metrics.withColumn(name, F.when(ref > 0, 1.0 - F.col(rmse) / ref))


def residual_correlation(wide: DataFrame, members: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``keys, model_a, model_b, correlation`` of residuals on observed active rows."""
    rows = observed(wide).where("active")
    res = {m: F.col("y") - F.col(m) for m in members}
    pairs = list(combinations(members, 2))
    agg = rows.groupBy(*keys).agg(*[F.corr(res[a], res[b]).alias(f"{a}|{b}") for a, b in pairs])
    cell = lambda a, b, v: F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), v.alias("correlation"))
    cells = [cell(m, m, F.lit(1.0)) for m in members]
    for a, b in pairs:
        v = F.col(f"`{a}|{b}`")
        cells += [cell(a, b, v), cell(b, a, v)]
    return agg.select(*keys, F.inline(F.array(*cells)))


def summarise_runs(raw: DataFrame, keys: Sequence[str], values: Sequence[str], run: str) -> DataFrame:
    return raw.groupBy(*keys).agg(
        *[F.avg(v).alias(f"{v}_mean") for v in values],
        *[F.stddev_samp(v).alias(f"{v}_sd") for v in values],
        F.count_distinct(run).alias("n_runs"),
    )


def gain(rmse: Column, base: Column) -> dict[str, Column]:
    ok = base > 0
    return {
        "abs_rmse_gain": F.when(ok, base - rmse),
        "rel_rmse_gain_pct": F.when(ok, (base - rmse) / base * 100.0),
    }


def best_per_group(metrics: DataFrame, keys: Sequence[str], by: str = "rmse", name: str = "model") -> DataFrame:
    """Row with the lowest score per group; the name breaks ties."""
    rest = [c for c in metrics.columns if c not in keys]
    return (
        metrics.where(F.col(by).isNotNull())
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(by, name)).alias("_r"))
        .select(*keys, "_r.*")
    )


def pivot_scores(metrics: DataFrame, rows: Sequence[str], column: str, value: str, values: Sequence[str], digits: int | None = None) -> DataFrame:
    v = F.first(value) if digits is None else F.round(F.first(value), digits)
    return metrics.groupBy(*rows).pivot(column, list(values)).agg(v)


def error_by_hour(pred: DataFrame) -> DataFrame:
    return (
        observed(pred)
        .groupBy("series_id", "protocol", "model", F.hour("ts").alias("hour"))
        .agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"))
    )


def error_by_bin(pred: DataFrame, driver: Column, lo: float, hi: float, bins: int) -> DataFrame:
    b = C.equal_bins(driver, lo, hi, bins)
    width = (hi - lo) / bins
    return (
        observed(pred)
        .withColumn("bin", b)
        .where(F.col("bin").isNotNull())
        .groupBy("series_id", "protocol", "model", "bin")
        .agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"))
        .withColumn("centre", F.lit(lo) + (F.col("bin") - 0.5) * width)
    )


def residual_table(pred: DataFrame, condition: Column, capacity: Column, keys: Sequence[str]) -> DataFrame:
    e = F.col("y") - F.col("yhat")
    rmse = F.sqrt(F.avg(e * e))
    return (
        observed(pred)
        .withColumn("condition", condition)
        .where(F.col("condition").isNotNull())
        .groupBy(*keys, "condition")
        .agg(
            F.count("*").alias("n"),
            F.avg(e).alias("bias"),
            rmse.alias("rmse"),
            F.avg("y").alias("mean_y"),
            (rmse / F.max(capacity) * 100.0).alias("nrmse_pct"),
        )
    )


def representative_week(pred: DataFrame, keys: Sequence[str], min_rows: int = 140, min_active: int = 25) -> DataFrame:
    """Monday of the week whose active RMSE is closest to the median of eligible weeks."""
    e = F.when(F.col("active"), F.col("y") - F.col("yhat"))
    weeks = (
        observed(pred)
        .groupBy(*keys, F.date_trunc("week", "ts").cast("date").alias("week"))
        .agg(F.count("*").alias("n"), F.count_if("active").alias("n_active"), F.sqrt(F.avg(e * e)).alias("rmse"))
        .where((F.col("n") >= min_rows) & (F.col("n_active") >= min_active))
    )
    median = F.percentile("rmse", 0.5).over(Window.partitionBy(*keys))
    away = F.round(F.abs(F.col("rmse") - F.col("_median")), 9)
    return (
        weeks.withColumn("_median", median)
        .groupBy(*keys)
        .agg(F.min_by(F.struct("week", "n", "rmse"), F.struct(away, "week")).alias("_r"), F.count("*").alias("n_weeks"))
        .select(*keys, "_r.week", "_r.n", "_r.rmse", "n_weeks")
    )


def day_extremes(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Easiest, typical (closest to the median) and hardest day by mean absolute error."""
    days = (
        observed(pred)
        .groupBy(*keys, day_of(F.col("ts")).alias("day"))
        .agg(F.avg(F.abs(F.col("y") - F.col("yhat"))).alias("mae"))
        .withColumn("mae", F.round("mae", 9))
    )
    w = Window.partitionBy(*keys)
    away = F.round(F.abs(F.col("mae") - F.col("_median")), 9)
    day = F.col("day")
    return (
        days.withColumn("_median", F.percentile("mae", 0.5).over(w))
        .groupBy(*keys)
        .agg(
            F.min_by(day, F.struct("mae", "day")).alias("easiest"),
            F.min_by(day, F.struct(away, day)).alias("typical"),
            F.min_by(day, F.struct(-F.col("mae"), day)).alias("hardest"),
            F.count("*").alias("n_days"),
        )
    )


def convention_gap(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """R2 and nRMSE of the same forecast on all and on active slots, side by side."""
    pick = lambda c, s: F.max(F.when(F.col("subset") == s, F.col(c)))
    out = metrics.groupBy(*keys).agg(
        pick("r2", "ALL").alias("r2_all"),
        pick("r2", "active").alias("r2_active"),
        pick("nrmse_pct", "ALL").alias("nrmse_all"),
        pick("nrmse_pct", "active").alias("nrmse_active"),
    )
    return out.withColumn("r2_gap", F.col("r2_all") - F.col("r2_active"))


def drift_check(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Compare stored expectations with recomputed values; unmatched keys are reported."""
    e = expected.select(*keys, F.col(value).alias("expected"), F.lit(1).alias("_e"))
    a = actual.select(*keys, F.col(value).alias("computed"), F.lit(1).alias("_a"))
    verdict = (
        F.when(F.col("_a").isNull(), "not computed")
        .when(F.col("_e").isNull(), "not expected")
        .when(F.col("expected").isNull() & F.col("computed").isNull(), "ok")
        .when(F.abs(F.col("expected") - F.col("computed")) <= tolerance, "ok")
        .otherwise("mismatch")
    )
    return e.join(a, list(keys), "full").withColumn("verdict", verdict).drop("_e", "_a")


def sweep_spread(scores: DataFrame, keys: Sequence[str], setting: str, value: str, reference) -> DataFrame:
    """Range of a score over a sweep and each setting's change from the reference setting."""
    w = Window.partitionBy(*keys)
    at_ref = F.max(F.when(F.col(setting) == F.lit(reference), F.col(value))).over(w)
    return scores.withColumn("spread", F.max(value).over(w) - F.min(value).over(w)).withColumn(
        "change", F.col(value) - at_ref
    )


def two_by_two(scores: DataFrame, keys: Sequence[str], a: str, b: str, value: str) -> DataFrame:
    """Effect of boolean factor ``a`` with and without ``b``, and their difference."""
    cell = lambda x, y: F.max(F.when((F.col(a) == x) & (F.col(b) == y), F.col(value)))
    out = scores.groupBy(*keys).agg(
        (cell(True, False) - cell(False, False)).alias("effect_without"),
        (cell(True, True) - cell(False, True)).alias("effect_with"),
    )
    return out.withColumn("interaction", F.col("effect_with") - F.col("effect_without"))


def fallback_audit(rows: DataFrame) -> DataFrame:
    """How often references had to fall back, per fold and pooled (``fold`` = 'ALL').

    ``rows`` are test rows with the flags ``lag_seen, back_seen, cell_seen, slot_seen``.
    """
    flags = {
        "lag_missing": "lag_seen",
        "lookback_exhausted": "back_seen",
        "unseen_cell": "cell_seen",
        "unseen_slot": "slot_seen",
    }
    aggs = [F.count("*").alias("scored")]
    for name, flag in flags.items():
        aggs += [F.count_if(~F.col(flag)).alias(name), (100.0 * F.count_if(~F.col(flag)) / F.count("*")).alias(f"{name}_pct")]
    return (
        observed(rows)
        .where("active")
        .groupingSets([["protocol", "fold"], ["protocol"]], "protocol", "fold")
        .agg(*aggs)
        .withColumn("fold", F.coalesce("fold", F.lit("ALL")))
    )


def membership_audit(scored: DataFrame, cells: DataFrame, cell: Sequence[str], slot: Sequence[str]) -> DataFrame:
    """How many scored rows have a cell, or a slot of the season, that the fold has never
    observed: ``*_train`` among the rows it trains on, ``*_both`` among those and its validation
    rows. Per fold and pooled (``fold`` = 'ALL'). ``cells`` is :func:`training_cells`; ``slot``
    are those of the cell's columns that name a season slot."""
    fold = ["series_id", "protocol", "fold"]
    slots = cells.groupBy(*fold, *slot).agg(F.max("in_train").alias("_slot"))
    rows = scored.join(cells.withColumnRenamed("in_train", "_cell"), [*fold, *cell], "left").join(slots, [*fold, *slot], "left")
    aggs = [F.count("*").alias("scored")]
    for name in ("cell", "slot"):
        gone = {"train": ~F.coalesce(f"_{name}", F.lit(False)), "both": F.col(f"_{name}").isNull()}
        aggs += [F.count_if(c).alias(f"unseen_{name}_{of}") for of, c in gone.items()]
    return rows.groupingSets([["protocol", "fold"], ["protocol"]], "protocol", "fold").agg(*aggs).withColumn("fold", F.coalesce("fold", F.lit("ALL")))


def lag_observed_scores(pred: DataFrame, reference: str) -> DataFrame:
    """Active-slot RMSE and skill on all scored rows and on those whose lag was observed."""
    tags = F.array_compact(F.array(F.lit("all scored"), F.when(F.col("lag_seen"), F.lit("lag observed"))))
    e = F.col("y") - F.col("yhat")
    keys = ["series_id", "protocol"]
    out = (
        observed(pred)
        .where("active")
        .withColumn("tag", F.explode(tags))
        .groupBy(*keys, "tag", "model")
        .agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))
    )
    most = F.max("n").over(Window.partitionBy(*keys))
    return add_skill(out.withColumn("pct_of_scored", 100.0 * F.col("n") / most), reference, [*keys, "tag"])


def density(pred: DataFrame, keys: Sequence[str], width: Column) -> DataFrame:
    """Counts per square cell of (actual, forecast); empty cells do not appear."""
    return (
        observed(pred)
        .where(F.col("yhat").isNotNull())
        .groupBy(*keys, F.floor(F.col("y") / width).alias("x_cell"), F.floor(F.col("yhat") / width).alias("y_cell"))
        .agg(F.count("*").alias("n"))
    )


def histogram(df: DataFrame, value: Column, keys: Sequence[str], lo: float = 0.0, hi: float = 2.0, bins: int = 80) -> DataFrame:
    """Counts in equal left-closed bins; the last bin includes its right edge."""
    width = (hi - lo) / bins
    v = F.col("_v")
    return (
        df.withColumn("_v", value)
        .where((v >= lo) & (v <= hi))
        .groupBy(*keys, F.least(F.floor((v - lo) / width), F.lit(bins - 1)).alias("bin"))
        .agg(F.count("*").alias("n"))
    )


def autocorrelation(panel: DataFrame, lags: int, min_pairs: int = 100, width: int = WIDTH) -> DataFrame:
    """Autocorrelation of the observed series at lags 0..``lags``.

    A chunk with the ``lags`` slots before it is an array; a lag is a product of two of its
    slices. The panel is shuffled once, and a chunk gives one row a lag.
    """
    stats = observed(panel).groupBy("series_id").agg(F.avg("y").alias("_mean"), F.var_pop("y").alias("_var"))
    centred = observed(panel).join(stats, "series_id").withColumn("_d", F.col("y") - F.col("_mean"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = (rows["slot"] - rows["slot"].min()).to_numpy() + lags
        d, seen, own = (np.zeros(at.max() + 1) for _ in range(3))
        d[at], seen[at], own[at] = rows["_d"], 1.0, rows["_own"]
        n = len(d) - lags
        products = [(lag, own[lags:] @ seen[lags - lag :][:n], (d * own)[lags:] @ d[lags - lag :][:n]) for lag in range(lags + 1)]
        out = pd.DataFrame(products, columns=["lag", "n", "s"]).astype({"n": "int64"})
        return out[out["n"] > 0].assign(series_id=rows["series_id"].iloc[0], v=rows["_var"].iloc[0])[["series_id", "lag", "n", "s", "v"]]

    rows = with_neighbours(centred.select("series_id", "slot", "_d", "_var"), before=lags, width=width)
    kind = f"series_id {panel.schema['series_id'].dataType.simpleString()}, lag bigint, n bigint, s double, v double"
    sums = rows.groupBy("series_id", "_chunk").applyInPandas(run, kind).groupBy("series_id", "lag").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("v").alias("v"))
    acf = F.when((F.col("n") > min_pairs) & (F.col("v") > 0), F.col("s") / F.col("n") / F.col("v")).otherwise(0.0)
    return sums.select("series_id", "lag", "n", acf.alias("acf"))


def period_power(panel: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Squared Fourier amplitude of the observed, centred series at named periods (in slots)."""
    stats = observed(panel).groupBy("series_id").agg(F.avg("y").alias("_mean"))
    p = F.col("period")
    angle = F.lit(2.0 * math.pi) * F.pmod(F.col("slot"), p) / p
    d = F.col("y") - F.col("_mean")
    return (
        observed(panel)
        .join(stats, "series_id")
        .withColumn("period", F.explode(F.array(*[F.lit(x) for x in periods])))
        .groupBy("series_id", "period")
        .agg(F.count("*").alias("n"), F.sum(d * F.cos(angle)).alias("_c"), F.sum(d * F.sin(angle)).alias("_s"))
        .select(
            "series_id",
            "period",
            "n",
            ((F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")) / (F.col("n") * F.col("n"))).alias("power"),
        )
    )
