"""The two panels built from the driver tables, with their backtest settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stage import stage
from ..functions.time import DAILY, HOURLY
from ..operators.features import active_by_elevation, active_by_label, add_cyclic, temporal_context
from ..operators.grid import attach, capacity
from ..operators.joins import fillable, with_drivers
from ..sources import tables
from .backtest import BASES, BOOSTED, Setup, boosted, forecasts, fuse, scored_frame, with_boosted

# The default site.
LAT, LON, TILT, FACING = 50.91, -1.40, 30.0, 180.0


@dataclass(frozen=True)
class Dataset:
    name: str
    setup: Setup
    panel: Callable[[SparkSession, str], DataFrame]
    frame: Callable[[SparkSession, str], DataFrame]


_stored: dict[tuple, DataFrame] = {}


def stored_as(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table with several readers, written once per application under a name."""
    key = (spark.sparkContext.applicationId, sf_dir, "named", name)
    if key not in _stored:
        _stored[key] = stage(make(), name)
    tables.ensure_utc(spark)
    return _stored[key]


def stored_drivers(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver table of a panel, written once per application: one row per slot."""
    key = (spark.sparkContext.applicationId, sf_dir, "drivers", name)
    if key not in _stored:
        build = tables.exog_h if name == "h" else tables.exog_d
        _stored[key] = stage(build(spark, sf_dir), f"drivers-{name}")
    tables.ensure_utc(spark)
    return _stored[key]


def stored_nearest(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table with the nearest values of every slot, ready to join."""
    key = (spark.sparkContext.applicationId, sf_dir, "nearest", name)
    if key not in _stored:
        exog = stored_drivers(spark, sf_dir, name)
        _stored[key] = stage(fillable(exog, [c for c in exog.columns if c != "slot"]), f"nearest-{name}")
    return _stored[key]


def hourly_frame(panel: DataFrame, exog: DataFrame) -> DataFrame:
    """Hourly panel with filled drivers, the elevation mask and the envelope driver."""
    drivers = ["n_events", "mean_value", "mean_k"]
    joined = with_drivers(panel, exog, drivers).drop("first_slot", "last_slot")
    return active_by_elevation(joined, LAT, LON).withColumn("driver", F.col("mean_value") * 10.0)


def _frame_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    drivers = ["n_orders", "mean_price"]
    panel = tables.panel_d(spark, sf_dir, bounds=True)
    joined = with_drivers(panel, stored_nearest(spark, sf_dir, "d"), drivers).drop("first_slot", "last_slot")
    return active_by_label(joined, capacity(joined), DAILY, 0.4).withColumn(
        "driver", F.col("mean_price") * 0.002
    )


H = Dataset(
    "h",
    Setup(
        HOURLY,
        24,
        ("n_events", "mean_value", "mean_k"),
        ("n_events", "mean_value"),
        rolling={"n_folds": 3, "first_test_days": 12, "min_train_rows": 50},
        random={"n_folds": 5, "seed": 0},
    ),
    tables.panel_h,
    lambda spark, sf: hourly_frame(tables.panel_h(spark, sf, bounds=True), stored_nearest(spark, sf, "h")),
)
D = Dataset(
    "d",
    Setup(
        DAILY,
        1,
        ("n_orders", "mean_price"),
        ("n_orders", "mean_price"),
        rolling={"n_folds": 4, "first_test_days": 730, "min_train_rows": 200},
        random={"n_folds": 5, "seed": 0},
    ),
    tables.panel_d,
    _frame_d,
)

# the daily panel with a short training head: early folds meet unseen months
E = replace(
    D,
    name="e",
    setup=replace(D.setup, rolling={"n_folds": 6, "first_test_days": 150, "min_train_rows": 100}),
)


def stored_frame(spark: SparkSession, sf_dir: str, ds: Dataset) -> DataFrame:
    """Panel with drivers, activity and capacity, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, ds.frame, "frame")
    if key not in _stored:
        frame = stage(ds.frame(spark, sf_dir), f"frame-{ds.name}")
        _stored[key] = attach(frame, capacity(frame), ["series_id"])
    tables.ensure_utc(spark)
    return _stored[key]


def stored_forecasts(spark: SparkSession, sf_dir: str, ds: Dataset) -> DataFrame:
    """The forecast table of a dataset, written once per application and then read.

    Scoring jobs read stored forecasts and never refit.
    """
    key = (spark.sparkContext.applicationId, sf_dir, ds.name)
    if key not in _stored:
        _stored[key] = stage(
            forecasts(stored_frame(spark, sf_dir, ds), ds.setup, stored=True), f"forecasts-{ds.name}"
        )
    tables.ensure_utc(spark)
    return _stored[key]


def stored_fused(spark: SparkSession, sf_dir: str, ds: Dataset, members=("Scaled", "OLS2")) -> DataFrame:
    """Test rows with every fused forecast of ``members``, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, ds.name, tuple(members))
    if key not in _stored:
        _stored[key] = stage(fuse(stored_forecasts(spark, sf_dir, ds), list(members)), f"fused-{ds.name}")
    return _stored[key]


def stored_rows(spark: SparkSession, sf_dir: str, ds: Dataset) -> DataFrame:
    """Assigned rows of a dataset (features, lookback, fold memberships), written once."""
    key = (spark.sparkContext.applicationId, sf_dir, ds.name, "rows")
    if key not in _stored:
        frame = add_cyclic(temporal_context(stored_frame(spark, sf_dir, ds), ["n_events", "mean_value"]))
        _stored[key] = stage(scored_frame(stage(frame, "context"), ds.setup)[0], f"rows-{ds.name}")
    tables.ensure_utc(spark)
    return _stored[key]


def stored_boosted(spark: SparkSession, sf_dir: str, ds: Dataset) -> DataFrame:
    """Boosted forecasts of every fold of a dataset, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, ds.name, "boosted")
    if key not in _stored:
        _stored[key] = stage(boosted(stored_rows(spark, sf_dir, ds), ds.setup), f"boosted-{ds.name}")
    return _stored[key]


def stored_all_fused(spark: SparkSession, sf_dir: str, ds: Dataset) -> DataFrame:
    """Test rows with the fusions of all six members, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, ds.name, "all-fused")
    if key not in _stored:
        wide = stage(with_boosted(stored_forecasts(spark, sf_dir, ds), stored_boosted(spark, sf_dir, ds)), f"six-{ds.name}")
        _stored[key] = stage(fuse(wide, [*BASES, *BOOSTED]), f"all-fused-{ds.name}")
    return _stored[key]
