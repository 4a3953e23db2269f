"""Which time shift lines a series up with its driver?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from .joins import at_shifts, moved_by_row
from .metrics import metric_columns
from .reference import physics_proxy
from .splits import fold_sums

SHIFTS = tuple(range(-3, 4))


def shift_pairs(frame: DataFrame, shifts: Sequence[int] = SHIFTS, carry: Sequence[str] = ()) -> DataFrame:
    """``y`` moved by each shift against the driver, active flag and ``carry`` columns at the new slot."""
    rows = frame.select("series_id", "slot", "driver", "active", *carry, "y")
    return at_shifts(rows, ["y"], shifts).drop("y").withColumnRenamed("src_y", "y")


def shift_scan(frame: DataFrame, shifts: Sequence[int] = SHIFTS) -> DataFrame:
    """R2 and nRMSE of ``capacity * driver / 1000`` on active observed slots, per shift.

    ``frame`` has ``series_id, slot, y, y_filled, driver, active, capacity``.
    """
    rows = shift_pairs(frame, shifts, ["capacity"]).where("active and y is not null")
    return (
        rows.withColumn("yhat", physics_proxy(F.col("capacity"), F.col("driver")))
        .groupBy("series_id", "shift")
        .agg(*metric_columns(capacity=F.col("capacity")))
    )


def peak_lag(frame: DataFrame, lags: Sequence[int] = SHIFTS, min_pairs: int = 10) -> DataFrame:
    """Lag with the highest correlation of ``y`` at t and the driver at t - lag.

    The mask is that of the y side only; the first maximum wins.
    """
    rows = frame.select("series_id", "slot", "y_filled", "driver", (F.col("active") & ~F.col("is_missing")).alias("_ok"))
    pairs = at_shifts(rows, ["driver"], lags).where("_ok").withColumnRenamed("shift", "lag")
    scored = pairs.groupBy("series_id", "lag").agg(
        F.count("*").alias("n"), F.round(F.corr("y_filled", "src_driver"), 9).alias("r")
    )
    ok = scored.where((F.col("n") >= min_pairs) & F.col("r").isNotNull())
    return ok.groupBy("series_id").agg(
        F.max_by(F.struct("lag", "r"), F.struct("r", -F.col("lag"))).alias("_b")
    ).select("series_id", F.col("_b.lag").alias("peak_lag"), F.col("_b.r").alias("correlation"))


def shift_scan_by_period(frame: DataFrame, periods: dict[str, Column], shifts: Sequence[int] = SHIFTS, min_rows: int = 100) -> DataFrame:
    """The scan inside overlapping periods, tagged in one pass; small cells are skipped.

    ``periods`` are conditions on columns of ``frame`` at the target slot.
    """
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in periods.items()]))
    tagged = frame.withColumn("_tags", tags)
    rows = shift_pairs(tagged, shifts, ["capacity", "_tags"]).where("active and y is not null")
    return (
        rows.withColumn("period", F.explode("_tags"))
        .withColumn("yhat", physics_proxy(F.col("capacity"), F.col("driver")))
        .groupBy("series_id", "period", "shift")
        .agg(*metric_columns())
        .where(F.col("n") >= min_rows)
    )


def best_shift(scan: DataFrame, keys: Sequence[str], score: str = "r2") -> DataFrame:
    """Shift with the highest score; the first wins a tie."""
    s = F.round(score, 9)
    return scan.where(F.col(score).isNotNull()).groupBy(*keys).agg(
        F.max_by("shift", F.struct(s, -F.col("shift"))).alias("selected_shift"),
        F.max(s).alias("best_score"),
    )


def offset_scan(frame: DataFrame, offset: Column, extras: Sequence[int] = (-2, -1, 0, 1)) -> DataFrame:
    """Score corrections that move each row by its own local offset (in slots) plus a constant."""
    target = frame.withColumn("_offset", offset).select("series_id", "slot", "driver", "active", "capacity", "_offset").where("active")
    source = frame.where("y is not null").select("series_id", "slot", "y")
    rows = moved_by_row(source, target, F.col("_offset"), extras)
    return (
        rows.withColumn("yhat", physics_proxy(F.col("capacity"), F.col("driver")))
        .groupBy("series_id", "extra")
        .agg(*metric_columns(capacity=F.col("capacity")))
    )


def shift_scan_by_fold(frame: DataFrame, splits: DataFrame, shifts: Sequence[int] = SHIFTS, q: float = 0.999, min_rows: int = 100) -> DataFrame:
    """The scan on each fold's training days, with the capacity of those rows.

    All days outside a fold's test block that the fold trains on count (its
    validation days included). Capacity is the quantile of the shifted observed
    values, so R2 follows from five sums and the capacity:
    sum (y - c g)^2 = yy - 2 c yg + c^2 gg.
    """
    pairs = shift_pairs(frame, shifts, ["ts"]).where("y is not null").withColumn("day", F.col("ts").cast("date"))
    days = splits.where(F.col("role") != "test").groupBy("series_id", "day").agg(
        F.collect_list(F.struct("protocol", "fold")).alias("train_of")
    )
    rows = pairs.join(days, ["series_id", "day"]).withColumn("is_missing", F.lit(False))
    g, y = F.col("driver") / 1000.0, F.col("y")
    a = lambda c: F.when(F.col("active"), c)
    sums = {"n": a(F.lit(1)), "_y": a(y), "_yy": a(y * y), "_yg": a(y * g), "_gg": a(g * g)}
    # both once per set of folds; no row is copied per fold
    keys = ["series_id", "protocol", "fold", "shift"]
    caps = exact_quantiles(rows, ["series_id", "shift"], "y", [q], spread="train_of").select(*keys, F.col("value").alias("capacity"))
    out = fold_sums(rows, sums, {"shift": F.col("shift")}).join(caps, keys)
    out = out.withColumns({"n": F.coalesce("n", F.lit(0)), "_sst": F.col("_yy") - F.col("_y") * F.col("_y") / F.col("n")})
    c = F.col("capacity")
    sse = F.col("_yy") - 2.0 * c * F.col("_yg") + c * c * F.col("_gg")
    return out.select(
        "series_id", "protocol", "fold", "shift", "n", "capacity",
        F.when((F.col("n") >= min_rows) & (F.col("_sst") > 0), 1.0 - sse / F.col("_sst")).alias("r2"),
    )
