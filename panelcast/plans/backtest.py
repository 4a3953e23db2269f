"""The headline backtest: both protocols, all folds, all series, in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stage import stage
from ..functions.time import Grid, season_slot
from ..operators import fold_models, fusion, linear, reference, splits
from ..operators.features import add_cyclic
from ..operators.grid import attach, capacity, day_facts, usable_days
from ..operators.metrics import add_skill, metric_columns, observed, to_long, with_subsets

FOLD = reference.FOLD
REFERENCES = ("Persistence", "Climatology", "SmartPersistence")
BASES = ("Scaled", "OLS2", "Ridge")
BOOSTED = fold_models.MEMBERS
CYCLES = ("doy_sin", "doy_cos", "hour_sin", "hour_cos")


@dataclass(frozen=True)
class Setup:
    """What a backtest needs to know besides its frame.

    The frame has ``series_id, slot, ts, y, y_filled, is_missing, active, driver``
    and the feature columns.
    """

    grid: Grid
    slots_per_day: int
    features: Sequence[str]
    pair: tuple[str, str]
    rolling: dict = field(default_factory=dict)
    random: dict = field(default_factory=dict)
    seasons: int = 7
    bound: float | Column | None = 1.5
    carry: tuple[str, ...] = ()
    missing: str = "null"
    drop_gap_days: bool = False


def scored_frame(frame: DataFrame, setup: Setup) -> tuple[DataFrame, DataFrame]:
    """Rows of usable days with lookback values and fold memberships, and the splits.

    The frame is read up to three times (capacity, days, rows): pass a stored one. Days are
    trimmed by the join with the fold table, which holds usable days only; lookback
    runs on the full grid before that. Days and the folds of each protocol are written, so that
    no task holds the sorts of both beside those of the joins.
    """
    full = frame if "capacity" in frame.columns else attach(frame, capacity(frame), ["series_id"])
    full = reference.with_lookback(full, setup.grid, "driver", setup.seasons, setup.missing)
    days = stage(usable_days(day_facts(frame), setup.slots_per_day, setup.drop_gap_days), "days")
    rolling = stage(splits.rolling_origin(days, **setup.rolling), "rolling")
    folds = rolling.unionByName(stage(splits.random_days(days, **setup.random), "random"))
    return splits.assign(full, folds), folds


def learn(assigned: DataFrame, setup: Setup, ridge: bool = True) -> DataFrame:
    """One row per (series, protocol, fold) with everything learnt from its training rows."""
    overall = assigned.groupBy("series_id").agg(F.max("capacity").alias("capacity"))
    caps = splits.fold_capacity(assigned, overall)
    features = setup.features if ridge else setup.pair
    return (
        caps.withColumnRenamed("capacity", "capacity_fold")
        .join(reference.climatology_profile(assigned, setup.grid), list(FOLD), "left")
        .join(reference.ratio_profile(assigned, caps, setup.grid, "driver", setup.bound, setup.carry), list(FOLD), "left")
        .join(linear.fit_together(assigned, features, setup.pair, ridge), list(FOLD), "left")
    )


def base_columns(setup: Setup, ridge: bool = True) -> dict[str, Column]:
    x1, x2 = (F.col(c) for c in setup.pair)
    floor = lambda c: F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))
    scaled = F.coalesce(floor(F.col("slope") * x1), F.lit(0.0))
    ols = floor(F.col("b0") + F.col("b1") * x1 + F.col("b2") * x2)
    out = {"Scaled": scaled, "OLS2": F.coalesce(ols, scaled)}
    if ridge:
        out["Ridge"] = F.coalesce(linear.linear_value(setup.features), scaled)
    return out


def forecast(assigned: DataFrame, learnt: DataFrame, setup: Setup, ridge: bool = True) -> DataFrame:
    """Wide forecasts of validation and test rows: one join to what the fold learnt."""
    rows = splits.eval_rows(assigned).join(learnt, list(FOLD))
    s = season_slot(F.col("slot"), setup.grid)
    cell = reference.cell_key(F.month("ts"), s)
    seen = {
        "lag_seen": F.col("prev_lag").isNotNull(),
        "back_seen": F.col("prev_y").isNotNull(),
        "cell_seen": F.try_element_at("clim_cell", cell).isNotNull(),
        "slot_seen": F.try_element_at("clim_slot", s).isNotNull(),
    }
    models = {**reference.reference_columns(setup.grid, "driver", setup.bound), **base_columns(setup, ridge)}
    return rows.select(
        *FOLD, "role", "slot", "ts", "day", "y", "active", "is_missing", "driver", "capacity", "capacity_fold",
        *[c.alias(n) for n, c in {**seen, **models}.items()],
    )


def boosted(assigned: DataFrame, setup: Setup, members: Sequence[str] = BOOSTED, rules: fold_models.Rules | None = None) -> DataFrame:
    """Boosted forecasts of validation and test rows, keyed by fold, role and slot, from the
    setup's features and the cycles of day and year."""
    caps = splits.fold_capacity(assigned, assigned.groupBy("series_id").agg(F.max("capacity").alias("capacity")))
    rules = rules or fold_models.Rules(bound=setup.bound if isinstance(setup.bound, (int, float)) else float("inf"))
    return fold_models.forecasts(add_cyclic(assigned), caps, [*setup.features, *CYCLES], "driver", rules, members)


def forecasts(frame: DataFrame, setup: Setup, ridge: bool = True, stored: bool = False, trees: Sequence[str] = ()) -> DataFrame:
    """Frame to wide forecasts. The frame (unless ``stored``) and the assigned rows are
    written once each, since capacity, days, profiles, fits and forecasts read them.
    ``trees`` names the boosted members wanted; their table has the same rows and is joined."""
    assigned = stage(scored_frame(frame if stored else stage(frame, "frame"), setup)[0], "assigned")
    wide = forecast(assigned, learn(assigned, setup, ridge), setup, ridge)
    return with_boosted(wide, boosted(assigned, setup, trees)) if trees else wide


def with_boosted(wide: DataFrame, trees: DataFrame) -> DataFrame:
    """Boosted members beside the others: one row for each row of ``wide``."""
    return wide.join(trees, [*FOLD, "role", "slot"], "left")


def fuse(wide: DataFrame, members: Sequence[str]) -> DataFrame:
    return fusion.apply(wide, fusion.fit(wide, members), members)


def score_all(fused: DataFrame, models: Sequence[str], keys: Sequence[str] = ("series_id", "protocol")) -> DataFrame:
    """Pooled metrics per model and subset with skill against smart persistence."""
    rows = with_subsets(observed(to_long(fused.where(F.col("role") == "test"), models)))
    scored = rows.groupBy(*keys, "model", "subset").agg(*metric_columns(capacity=F.col("capacity")))
    return add_skill(scored, "SmartPersistence", [*keys, "subset"])


def headline(frame: DataFrame, setup: Setup, members: Sequence[str] = (*BASES, *BOOSTED)) -> DataFrame:
    """Panel frame to the metric table of references, members and fusions. The forecasts are
    written once, since weights and fusions read them."""
    wide = forecasts(frame, setup, "Ridge" in members, trees=[m for m in members if m in BOOSTED])
    fused = fuse(stage(wide, "forecasts"), members)
    return score_all(fused, [*REFERENCES, *members, *fusion.VARIANTS])
