"""Boosted forecasts of every series and fold in one job.

Rows are shuffled once by (series, protocol, fold). A fold's rows are at most the slots of
its series on the grid, however long the log is, so a task holds them; it fits the
plain, the ratio and the 24 hourly models of the fold and forecasts its validation and
test rows. Settings and rules are those of the library's other per-fold models: folds
never see rows of each other, and rows held out for early stopping are drawn by hash of
(series, slot), whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import draw_int
from ..functions.trees import Boosting, boost
from . import splits

FOLD = ("series_id", "protocol", "fold")
MEMBERS = ("GBM", "GBM_kt", "GBM_per_hour")


@dataclass(frozen=True)
class Rules:
    """``floor``: rows below this driver are not fitted as ratios and forecast 0 there;
    ``least_ratio``: more fitted rows than this, or the plain model stands in;
    ``least_hour``: an hour with fewer training rows forecasts 0."""

    plain: Boosting = field(default_factory=Boosting)
    ratio: Boosting = field(default_factory=Boosting)
    hour: Boosting = field(default_factory=lambda: Boosting(rounds=500, rate=0.05, depth=6, min_leaf=15, penalty=0.2, patience=15, held=0.15))
    bound: float = 1.5
    floor: float = 50.0
    least_ratio: int = 200
    least_hour: int = 30


def held_draw(seed: str = "stop") -> Column:
    """A number below a million for each (series, slot): rows below a share are held out."""
    return draw_int(F.lit(1_000_000), seed, F.col("series_id"), F.col("slot"))


def fold_rows(assigned: DataFrame, caps: DataFrame, features: Sequence[str], driver: str) -> DataFrame:
    """Training rows and rows to forecast of each fold, with features as one array and the
    capacity that the fold knows."""
    x = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    narrow = assigned.select(
        "series_id", "slot", F.hour("ts").alias("hour"), F.col("y").cast("double").alias("y"), "is_missing", "active", F.col(driver).cast("double").alias("g"),
        held_draw().alias("draw"), "train_of", "eval_of", x,
    )
    long = splits.train_rows(narrow).withColumn("role", F.lit("train")).unionByName(splits.eval_rows(narrow))
    return long.join(caps.select(*FOLD, F.col("capacity").cast("double").alias("cap")), list(FOLD))


def fit_fold(x: np.ndarray, y: np.ndarray, g: np.ndarray, hour: np.ndarray, draw: np.ndarray, train: np.ndarray, cap: float, rules: Rules, members: Sequence[str] = MEMBERS) -> dict[str, np.ndarray]:
    """Forecasts of all rows by each member, floored at 0."""
    held = lambda o: draw < o.held * 1_000_000
    out = {}
    if "GBM" in members or "GBM_kt" in members:
        out["GBM"] = np.maximum(boost(x, y, train, held(rules.plain), rules.plain), 0.0)
    if "GBM_kt" in members:
        usable = train & (g > rules.floor)
        if usable.sum() > rules.least_ratio:
            unit = np.maximum(np.nan_to_num(cap * g / 1000.0), 1.0)
            ratio = boost(x, np.clip(y / unit, 0.0, rules.bound), usable, held(rules.ratio), rules.ratio)
            out["GBM_kt"] = np.where(g >= rules.floor, np.clip(ratio, 0.0, rules.bound) * unit, 0.0)
        else:
            out["GBM_kt"] = out["GBM"]
    if "GBM_per_hour" in members:
        value = np.zeros(len(y))
        for h in np.unique(hour):
            own = np.flatnonzero(hour == h)
            if train[own].sum() >= rules.least_hour:
                value[own] = np.maximum(boost(x[own], y[own], train[own], held(rules.hour)[own], rules.hour), 0.0)
        out["GBM_per_hour"] = value
    return {m: out[m] for m in members}


def _arrays(rows: pd.DataFrame) -> tuple:
    # by slot, so that sums do not depend on the order in which rows arrive
    rows = rows.sort_values(["slot", "role"], kind="stable", ignore_index=True)
    x = np.stack(rows["x"].to_numpy()).astype(float) if len(rows) else np.zeros((0, 0))
    return rows, x, *(rows[c].to_numpy(dtype=float, na_value=np.nan) for c in ("y", "g", "hour", "draw")), (rows["role"] == "train").to_numpy()


def forecasts(assigned: DataFrame, caps: DataFrame, features: Sequence[str], driver: str = "driver", rules: Rules | None = None, members: Sequence[str] = MEMBERS) -> DataFrame:
    """``series_id, protocol, fold, role, slot`` and a column for each member: every row that a
    fold validates or tests, once. A missing feature is a value of its own to a tree."""
    rules, members = rules or Rules(), list(members)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, x, y, g, hour, draw, train = _arrays(rows)
        out = rows[[*FOLD, "role", "slot"]].assign(**fit_fold(x, y, g, hour, draw, train, float(rows["cap"].iloc[0]), rules, members))
        return out[~train]

    rows = fold_rows(assigned, caps, features, driver)
    kind = ", ".join(f"{f} {rows.schema[f].dataType.simpleString()}" for f in (*FOLD, "role", "slot")) + ", " + ", ".join(f"{m} double" for m in members)
    return rows.groupBy(*FOLD).applyInPandas(run, kind)


def importance(assigned: DataFrame, caps: DataFrame, features: Sequence[str], driver: str = "driver", rules: Rules | None = None, repeats: int = 3, seed: int = 0) -> DataFrame:
    """``series_id, protocol, fold, feature, importance``: mean rise of the RMSE on active, observed test rows when
    a feature's values are dealt to other rows of them. The plain model is fitted once a
    fold; all deals are forecast together."""
    rules, names = rules or Rules(), list(features)
    rows = fold_rows(assigned, caps, features, driver)
    kind = ", ".join(f"{f} {rows.schema[f].dataType.simpleString()}" for f in FOLD) + ", feature string, repeat int, sse double, n bigint"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame, x, y, _, _, draw, train = _arrays(frame)
        test = np.flatnonzero((frame["role"] == "test") & frame["active"] & ~frame["is_missing"])
        deals = [("-", 0)] + [(f, r) for f in names for r in range(repeats)]
        blocks = [x]
        for f, r in deals[1:]:
            dealt = x[test].copy()
            order = np.random.default_rng([seed, r, names.index(f)]).permutation(len(test))
            dealt[:, names.index(f)] = dealt[order, names.index(f)]
            blocks.append(dealt)
        grown = len(x) + (len(deals) - 1) * len(test)
        pad = lambda a, fill: np.concatenate([a, np.full(grown - len(a), fill)])
        value = np.maximum(boost(np.concatenate(blocks), pad(y, 0.0), pad(train, False), pad(draw < rules.plain.held * 1_000_000, False), rules.plain), 0.0)
        forecasts = [value[test], *value[len(x) :].reshape(len(deals) - 1, len(test))]
        key = {f: frame[f].iloc[0] for f in FOLD}
        return pd.DataFrame([{**key, "feature": f, "repeat": r, "sse": float(((y[test] - v) ** 2).sum()), "n": len(test)} for (f, r), v in zip(deals, forecasts)])

    scored = rows.groupBy(*FOLD).applyInPandas(run, kind).where("n > 0").withColumn("rmse", F.sqrt(F.col("sse") / F.col("n")))
    plain = F.max(F.when(F.col("feature") == "-", F.col("rmse")))
    per_fold = scored.groupBy(*FOLD).agg(plain.alias("_plain"), F.collect_list(F.struct("feature", "repeat", "rmse")).alias("_all"))
    each = per_fold.select(*FOLD, "_plain", F.inline("_all")).where("feature != '-'")
    return each.groupBy(*FOLD, "feature").agg(F.avg(F.col("rmse") - F.col("_plain")).alias("importance"))
