"""What a model gains from knowing which past values and targets are missing.

Four arms cross two uses of the mask: the availability of past values as features, and
weights that leave missing targets out of the loss instead of fitting zeros. All arms are
ridge on the same day windows. Moments are summed once per fold, under both weightings;
an arm picks a weighting and a block of features.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.solve import ridge_from_moments
from ..functions.special import student_t_two_sided
from ..functions.time import day_of
from ..operators import linear
from ..operators.features import supervised_windows
from ..operators.inference import day_losses, diebold_mariano

FOLD = ("series_id", "protocol", "fold")
#: arm: (availability as features, missing targets left out of the loss)
ARMS = {"full": (True, True), "no_channel": (False, True), "no_loss_weighting": (True, False), "neither": (False, False)}
NAIVE = "neither"


def hour_rows(frame: DataFrame, splits: DataFrame, drivers: Sequence[str], history: int = 7) -> tuple[DataFrame, list[str], list[str]]:
    """Windows of every fold, one row per target hour: past values ``p<k>`` and their
    availability ``a<k>`` at the same hour, drivers at the hour, the scaled ``target``, the weights
    ``naive`` and ``masked``, and ``evaluate``. History from days that a fold does not train on is
    hidden. Also the names of the plain features and of the availability features."""
    days = splits.select("series_id", "day", "protocol", "fold", "role")
    rows = frame.withColumn("day", day_of(F.col("ts"))).join(days, ["series_id", "day"]).withColumn("_seen", (~F.col("is_missing")).cast("double"))
    inputs = [*drivers, "_seen"]
    windows = supervised_windows(rows, F.col("capacity"), inputs, FOLD, history, True, True, F.col("role") != "train")
    caps = rows.groupBy(*FOLD).agg(F.max("capacity").alias("capacity"))
    windows = windows.join(days, [*FOLD, "day"]).join(caps, list(FOLD))
    hour = windows.select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    at = lambda c, k: F.get(F.get(c, F.lit(k)), F.col("hour"))
    flat = lambda c: F.get(c, F.col("hour"))
    past = {f"p{k}": at("pv", k) for k in range(history)}
    seen = {f"a{k}": at("available", k) for k in range(history)}
    now = {f"x_{d}": F.coalesce(at(d, history), F.lit(0.0)) for d in drivers}
    out = hour.select(
        *FOLD, "day", "hour", "role", "capacity", *[c.alias(n) for n, c in {**past, **seen, **now}.items()],
        flat("target").alias("target"), flat("weight").alias("naive"), (flat("weight") * at("_seen", history)).alias("masked"), flat("evaluate").alias("evaluate"),
    )
    return out, [*past, *now], list(seen)


def fit_arms(rows: DataFrame, plain: Sequence[str], seen: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """One row per fold with a coefficient array per arm over ``plain`` and ``seen``."""
    union = [*plain, *seen]
    weightings = ("masked", "naive")
    sums = {f"{w}_{n}": F.sum(c) for w in weightings for n, c in linear.moment_sums(union, "target", F.col(w)).items()}
    per_fold = rows.where("role = 'train'").groupBy(*FOLD).agg(*[c.alias(n) for n, c in sums.items()])
    packed = None
    for w in weightings:
        names = linear.moment_sums(union, "target")
        own = linear.pack_moments(per_fold.select(*FOLD, *[F.col(f"{w}_{n}").alias(n) for n in names]), len(union), FOLD)
        own = own.withColumn("weighting", F.lit(w))
        packed = own if packed is None else packed.unionByName(own)

    def solve(moments: pd.DataFrame) -> pd.DataFrame:
        out = {f: moments[f].iloc[0] for f in FOLD}
        for arm, (channel, masked) in ARMS.items():
            m = moments[moments["weighting"] == (weightings[0] if masked else weightings[1])].iloc[0]
            idx = list(range(len(union) if channel else len(plain)))
            x, xx, xy = (np.asarray(m[c], float) for c in ("sx", "sxx", "sxy"))
            full = np.zeros(len(union) + 1)
            if m["n"] > 0:
                icept, beta = ridge_from_moments(m["n"], x[idx], xx.reshape(len(union), -1)[np.ix_(idx, idx)], m["sy"], xy[idx], alpha, True)
                full[0], full[1 : len(idx) + 1] = icept, beta
            out[arm] = full.tolist()
        return pd.DataFrame([out])

    kind = T.StructType([packed.schema[f] for f in FOLD] + [T.StructField(a, T.ArrayType(T.DoubleType())) for a in ARMS])
    return packed.groupBy(*FOLD).applyInPandas(solve, kind)


def arm_forecasts(rows: DataFrame, plain: Sequence[str], seen: Sequence[str]) -> DataFrame:
    """Evaluated test hours with ``y`` and a forecast per arm, in the units of the series.
    ``rows`` is read twice: pass a stored table."""
    fits = fit_arms(rows, plain, seen).withColumnsRenamed({a: f"_{a}" for a in ARMS})
    test = rows.where("role = 'test' and evaluate = 1").join(fits, list(FOLD))
    value = {a: F.col("capacity") * linear.linear_value([*plain, *seen], f"_{a}") for a in ARMS}
    ts = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour"))
    return test.select(*FOLD, "capacity", ts.alias("ts"), (F.col("capacity") * F.col("target")).alias("y"), *[c.alias(a) for a, c in value.items()])


def _day_test(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Student's t over the days' mean differences in squared error."""
    d = (F.col("la") - F.col("lb")) / F.col("n")
    t = days.groupBy(*keys).agg(F.count("*").alias("n_days"), F.avg(d).alias("_m"), F.var_samp(d).alias("_v"))
    ok = (F.col("n_days") >= 8) & (F.col("_v") > 0)
    t = t.withColumn("day_statistic", F.when(ok, F.col("_m") / F.sqrt(F.col("_v") / F.col("n_days"))))
    return t.withColumn("day_p", student_t_two_sided("day_statistic", (F.col("n_days") - 1).cast("double"))).drop("_m", "_v")


def score_arms(forecasts: DataFrame, keys: Sequence[str] = ("series_id", "protocol")) -> DataFrame:
    """``keys, arm``: rows, RMSE, and the hour and day tests against the arm without a mask
    (negative: the arm is better). The naive arm has no test against itself."""
    listed = [F.struct(F.lit(a).alias("arm"), F.col(a).alias("own"), F.col(NAIVE).alias("naive")) for a in ARMS]
    rows = forecasts.select(*keys, "ts", "y", F.inline(F.array(*listed)))
    group = [*keys, "arm"]
    e: Column = F.col("y") - F.col("own")
    rmse = rows.groupBy(*group).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))
    others = rows.where(F.col("arm") != NAIVE)
    hour = diebold_mariano(others, group, "own", "naive").select(*group, "mean_diff", F.col("statistic").alias("hour_statistic"), F.col("p_value").alias("hour_p"))
    day = _day_test(day_losses(others, group, "own", "naive"), group)
    return rmse.join(hour, group, "left").join(day, group, "left")
