"""Experiment grids: a setting is a key, so one plan covers all settings.

Where a setting changes the data, the panel is repeated per setting with the
setting in front of the series id; where it changes only a model, the shared
rows are read once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.solve import ridge_from_moments
from ..functions.stage import stage
from ..functions.time import Grid, ts_of
from ..operators import linear, reference, splits
from ..operators.grid import day_facts, relabel, usable_days
from ..operators.inference import diebold_mariano
from ..operators.metrics import (
    add_skill,
    metric_columns,
    observed,
    summarise_runs,
    sweep_spread,
    to_long,
    with_subsets,
)
from .backtest import FOLD, Setup, forecast, forecasts, learn, scored_frame

SEP = "/"


def repeat(frame: DataFrame, settings: Sequence[str], column: str = "config") -> DataFrame:
    """Every row once per setting, with a composite series id."""
    return frame.withColumn(column, F.explode(F.array(*[F.lit(s) for s in settings]))).withColumn(
        "series_id", F.concat_ws(SEP, column, "series_id")
    )


def stack_frames(frames: dict[str, DataFrame]) -> DataFrame:
    """Frames that differ by setting, united under composite series ids."""
    parts = [f.withColumn("series_id", F.concat_ws(SEP, F.lit(name), "series_id")) for name, f in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def split_key(df: DataFrame, column: str = "config") -> DataFrame:
    parts = F.split("series_id", SEP, 2)
    return df.withColumns({column: parts.getItem(0), "series_id": parts.getItem(1)})


def ridge_variants(assigned: DataFrame, variants: dict[str, Sequence[str]], alpha: float = 1.0) -> tuple[DataFrame, list[str]]:
    """Ridge for several feature lists from one pass over the rows.

    The moments of the union of features are summed once per set of variants that a row
    is complete for; a variant adds up the sets it is in and solves its own block. So a row
    without one product's value still trains the others. Returns a table with one coefficient
    array per variant (over the union, zero for features it does not use; null without rows)
    and the union.
    """
    union = list(dict.fromkeys(f for fs in variants.values() for f in fs))
    complete = [F.when(linear.complete_case(fs), 1 << i).otherwise(0) for i, fs in enumerate(variants.values())]
    present = assigned.where(linear.complete_case(["y"])).withColumn("_set", reduce(Column.__add__, complete)).where("_set > 0")
    filled = present.withColumns({f: F.when(linear.complete_case([f]), F.col(f)).otherwise(0.0) for f in union})
    packed = linear.pack_moments(splits.fold_sums(filled, linear.moment_sums(union), {"_set": F.col("_set")}), len(union), [*FOLD, "_set"])
    blocks = {name: [union.index(f) for f in fs] for name, fs in variants.items()}

    def solve(sets: pd.DataFrame) -> pd.DataFrame:
        out = {f: sets[f].iloc[0] for f in FOLD}
        for i, (name, idx) in enumerate(blocks.items()):
            mine = sets[sets["_set"].to_numpy() >> i & 1 == 1]
            if not len(mine):
                out[name] = None
                continue
            x, xx, xy = (np.sum([np.asarray(v, float) for v in mine[c]], axis=0) for c in ("sx", "sxx", "sxy"))
            xx = xx.reshape(len(union), len(union))
            icept, beta = ridge_from_moments(mine["n"].sum(), x[idx], xx[np.ix_(idx, idx)], mine["sy"].sum(), xy[idx], alpha, True)
            full = np.zeros(len(union))
            full[idx] = beta
            out[name] = [icept, *full]
        return pd.DataFrame([out])

    kind = T.StructType([packed.schema[f] for f in FOLD] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in blocks])
    return packed.groupBy(*FOLD).applyInPandas(solve, kind), union


def variant_forecasts(assigned: DataFrame, variants: dict[str, Sequence[str]]) -> DataFrame:
    """Test rows of every fold with a ridge forecast per feature list, a column each."""
    coefs, _ = ridge_variants(assigned, variants)
    union = list(dict.fromkeys(f for fs in variants.values() for f in fs))
    at = {f: i for i, f in enumerate(union)}
    rows = splits.eval_rows(assigned).where(F.col("role") == "test").join(coefs, list(FOLD))

    def value(name: str, features: Sequence[str]) -> Column:
        out = F.get(name, F.lit(0))
        for f in features:
            out = out + F.get(name, F.lit(at[f] + 1)) * F.col(f)
        return F.when(out.isNotNull(), F.greatest(out, F.lit(0.0)))

    wide = rows.withColumns({f"_{n}": value(n, fs) for n, fs in variants.items()})
    return wide.drop(*variants).withColumnsRenamed({f"_{n}": n for n in variants})


def feature_ablation(assigned: DataFrame, variants: dict[str, Sequence[str]]) -> DataFrame:
    """Scores of ridge per feature list, test rows of every fold."""
    long = to_long(variant_forecasts(assigned, variants), list(variants)).withColumnRenamed("model", "config")
    return (
        with_subsets(observed(long))
        .groupBy("series_id", "protocol", "config", "subset")
        .agg(*metric_columns(capacity=F.col("capacity")))
    )


def compare_products(frames: dict[str, DataFrame], setup: Setup, models: Sequence[str], ridge: bool = False) -> DataFrame:
    """Forecasts of the same panel under several driver products, keyed by ``config``."""
    wide = forecasts(stack_frames(frames), setup, ridge).where(F.col("role") == "test")
    return split_key(to_long(wide, models))


def price_pairs(pred: DataFrame, pairs: Sequence[tuple[str, str, str]], model: str) -> DataFrame:
    """Each (name, reference, variant) pair on common active slots: RMSE change and DM test."""
    rows = observed(pred).where(F.col("active") & (F.col("model") == model))
    keys = ["series_id", "protocol", "slot"]
    wanted = F.array(
        *[
            F.struct(F.lit(n).alias("comparison"), F.lit(ref).alias("_ref"), F.lit(var).alias("_var"))
            for n, ref, var in pairs
        ]
    )
    tagged = rows.select(*keys, "config", "y", "yhat", "capacity", F.inline(wanted)).where("config = _ref or config = _var")
    both = (
        tagged.groupBy(*keys, "comparison")
        .agg(
            F.first("y").alias("y"),
            F.max("capacity").alias("capacity"),
            F.max(F.when(F.col("config") == F.col("_ref"), F.col("yhat"))).alias("reference"),
            F.max(F.when(F.col("config") == F.col("_var"), F.col("yhat"))).alias("variant"),
        )
        .where("reference is not null and variant is not null")
    )
    return _priced(both)


def price_columns(wide: DataFrame, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Each (name, reference, variant) pair of forecast columns on active observed rows that
    have both: RMSE change and DM test. A row is read once for all pairs."""
    listed = [F.struct(F.lit(n).alias("comparison"), F.col(a).alias("reference"), F.col(b).alias("variant")) for n, a, b in pairs]
    rows = observed(wide).where("active").select("series_id", "protocol", "slot", "y", "capacity", F.inline(F.array(*listed)))
    return _priced(rows.where("reference is not null and variant is not null"))


def _priced(both: DataFrame) -> DataFrame:
    group = ["comparison", "series_id", "protocol"]
    rmse = lambda c: F.sqrt(F.avg((F.col("y") - F.col(c)) * (F.col("y") - F.col(c))))
    change = both.groupBy(*group).agg(
        rmse("reference").alias("reference_rmse"), rmse("variant").alias("variant_rmse"), F.max("capacity").alias("_cap")
    )
    dm = diebold_mariano(both, group, "variant", "reference")
    return change.join(dm, group).select(
        *group,
        F.col("n").alias("n_common"),
        "reference_rmse",
        "variant_rmse",
        (100.0 * (F.col("variant_rmse") - F.col("reference_rmse")) / F.col("_cap")).alias("nrmse_change_pp"),
        (100.0 * (F.col("variant_rmse") / F.col("reference_rmse") - 1.0)).alias("relative_rmse_change_pct"),
        "statistic",
        "p_value",
        "better",
    )


def bound_sweep(frame: DataFrame, setup: Setup, bounds: Sequence[float], reference_bound: float) -> DataFrame:
    """Smart persistence under several ratio bounds (infinite allowed) with spread and change.

    ``frame`` should be a stored table: capacity, days and rows read it.
    """
    assigned = stage(scored_frame(frame, setup)[0], "bounds")
    caps = splits.fold_capacity(assigned, assigned.groupBy("series_id").agg(F.max("capacity").alias("capacity")))
    spread = F.explode(F.array(*[F.lit(float(b)) for b in bounds]))
    keyed = assigned.withColumn("bound", spread).withColumn("_id", F.col("series_id")).withColumn(
        "series_id", F.concat_ws(SEP, F.col("bound").cast("string"), "series_id")
    )
    many = caps.withColumn("bound", spread).withColumn("series_id", F.concat_ws(SEP, F.col("bound").cast("string"), "series_id"))
    ratios = reference.ratio_profile(keyed, many, setup.grid, "driver", F.col("bound"), ("bound",))
    rows = (
        splits.eval_rows(keyed)
        .where(F.col("role") == "test")
        .join(many.select(*FOLD, F.col("capacity").alias("capacity_fold")), list(FOLD))
        .join(ratios, list(FOLD), "left")
        .withColumns({"clim_all": F.lit(0.0), "clim_slot": F.create_map(F.lit(0), F.lit(0.0)), "clim_cell": F.create_map(F.lit(0), F.lit(0.0))})
    )
    yhat = reference.reference_columns(setup.grid, "driver", F.col("bound"))["SmartPersistence"]
    scores = (
        with_subsets(observed(rows.withColumn("yhat", yhat).drop("series_id").withColumnRenamed("_id", "series_id")))
        .groupBy("series_id", "protocol", "subset", "bound")
        .agg(*metric_columns(capacity=F.col("capacity")))
        .select("series_id", "protocol", "subset", "bound", "n", "rmse", "nrmse_pct")
    )
    return sweep_spread(scores, ["series_id", "protocol", "subset"], "bound", "nrmse_pct", reference_bound)


def shifted_frames(panel: DataFrame, grid: Grid, shifts: Sequence[int]) -> dict[str, DataFrame]:
    """The panel relabelled by each shift."""
    ends = [c for c in ("first_slot", "last_slot") if c in panel.columns]
    return {
        str(s): relabel(panel, s)
        .withColumns({c: F.col(c) + s for c in ends})
        .withColumn("ts", ts_of(F.col("slot"), grid))
        for s in shifts
    }


def seed_repetition(frame: DataFrame, setup: Setup, seeds: Sequence[int], models: Sequence[str]) -> DataFrame:
    """Mean and spread of scores over seeded random day folds, with skill on mean RMSE."""
    names = [str(s) for s in seeds]
    rows = stage(reference.with_lookback(frame, setup.grid, "driver", setup.seasons, setup.missing), "frame")
    options = {k: v for k, v in setup.random.items() if k != "seed"}
    days = repeat(usable_days(day_facts(rows), setup.slots_per_day), names, "seed")
    folds = splits.random_days(days, seed=F.col("seed").cast("int"), **options)
    assigned = stage(splits.assign(repeat(rows, names, "seed"), folds), "seeds")
    plain = replace(setup, features=list(setup.pair))
    wide = forecast(assigned, learn(assigned, plain, ridge=False), plain, ridge=False).where(F.col("role") == "test")
    scores = (
        with_subsets(observed(split_key(to_long(wide, models), "seed")))
        .groupBy("series_id", "protocol", "model", "subset", "seed")
        .agg(*metric_columns(capacity=F.col("capacity")))
    )
    keys = ["series_id", "protocol", "model", "subset"]
    runs = summarise_runs(scores, keys, ["r2", "mae", "rmse"], "seed")
    return add_skill(runs, "SmartPersistence", ["series_id", "protocol", "subset"], rmse="rmse_mean")


def missing_arms(assigned: DataFrame, features: Sequence[str]) -> DataFrame:
    """How missing targets reach a fit: left out, as zeros, or left out with active
    rows weighted 4. Ridge per arm on the same test rows, tested against zeros."""
    zeros = assigned.withColumns({"y": F.col("y_filled"), "is_missing": F.lit(False)})
    weight = F.when(F.col("active"), 4.0).otherwise(1.0)
    arms = {
        "left_out": linear.ridge(assigned, features),
        "as_zero": linear.ridge(zeros, features),
        "weighted": linear.ridge(assigned, features, weight=weight),
    }
    rows = splits.eval_rows(assigned).where(F.col("role") == "test")
    for name, fit in arms.items():
        rows = rows.join(fit.select(*FOLD, F.col("coef").alias(f"_{name}")), list(FOLD))
        rows = rows.withColumn(name, linear.linear_value(features, f"_{name}")).drop(f"_{name}")
    usable = observed(rows).where("active")
    out = []
    for arm in ("left_out", "weighted"):
        test = diebold_mariano(usable, ["series_id", "protocol"], arm, "as_zero")
        e = F.col("y") - F.col(arm)
        rmse = usable.groupBy("series_id", "protocol").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
        out.append(test.join(rmse, ["series_id", "protocol"]).withColumn("arm", F.lit(arm)))
    return out[0].unionByName(out[1])

