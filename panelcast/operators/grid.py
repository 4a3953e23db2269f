"""Regular panels: relabelling, gridding, fills, complete days, capacity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import WIDTH, fill_both_ways
from ..functions.quantiles import exact_quantiles
from ..functions.time import Grid, day_of, slot_of, ts_of


def relabel(df: DataFrame, slots: int | Column) -> DataFrame:
    """Move every reading by a number of slots."""
    return df.withColumn("slot", F.col("slot") + slots)


def with_slot(readings: DataFrame, grid: Grid) -> DataFrame:
    return readings.withColumn("slot", slot_of(F.col("ts"), grid))


def slot_spans(readings: DataFrame) -> DataFrame:
    return readings.groupBy("series_id").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))


def regular_grid(
    values: DataFrame,
    grid: Grid,
    spans: DataFrame | None = None,
    width: int = WIDTH,
    bounds: bool = False,
) -> DataFrame:
    """Every slot between a series' first and last reading, exactly once.

    ``values`` has one row per ``series_id, slot`` with ``y``. Each reading emits
    itself and the empty slots up to the next one, inside chunks of ``width``
    slots, so one shuffle of the readings is enough and a long series or a long
    gap is spread over tasks. ``spans`` (``series_id, lo, hi``) may be given
    when it is cheaper to get from the raw readings. ``bounds=True`` also returns
    each series' ``first_slot`` and ``last_slot``, which the chunk marks carry along.
    """
    if spans is None:
        spans = slot_spans(values)
    chunk = F.floor(F.col("slot") / F.lit(width)).cast("bigint")
    c = F.col("_chunk")
    chunks = spans.withColumn(
        "_chunk",
        F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width)).cast("array<bigint>")),
    )
    # per chunk: where it starts inside the span, and one past where it ends
    ends = ["lo", "hi"] if bounds else []
    marks = chunks.select(
        "series_id",
        "_chunk",
        *ends,
        F.explode(
            F.array(
                F.struct(F.greatest(c * width, F.col("lo")).alias("slot"), F.lit(0).alias("_kind")),
                F.struct(F.least((c + 1) * width, F.col("hi") + 1).alias("slot"), F.lit(2).alias("_kind")),
            )
        ).alias("m"),
    ).select("series_id", "_chunk", *ends, "m.slot", F.lit(None).cast("double").alias("y"), "m._kind")
    rows = values.select("series_id", chunk.alias("_chunk"), "slot", "y", F.lit(1).alias("_kind"))
    w = Window.partitionBy("series_id", "_chunk").orderBy("slot", "_kind")
    kept = {"lo": "first_slot", "hi": "last_slot"} if bounds else {}
    return (
        rows.unionByName(marks, allowMissingColumns=True)
        .withColumns(
            {
                "_next": F.lead("slot").over(w),
                # every chunk starts with a mark that knows the span
                **{n: F.first(c).over(w) for c, n in kept.items()},
            }
        )
        .where((F.col("_kind") < 2) & (F.col("_next") > F.col("slot")))
        .select(
            "series_id",
            *kept.values(),
            "y",
            "_kind",
            F.posexplode(F.sequence("slot", F.col("_next") - 1)).alias("_pos", "slot"),
        )
        .withColumn("y", F.when((F.col("_pos") == 0) & (F.col("_kind") == 1), F.col("y")))
        .select(
            "series_id",
            "slot",
            ts_of(F.col("slot"), grid).alias("ts"),
            "y",
            F.coalesce(F.greatest("y", F.lit(0.0)), F.lit(0.0)).alias("y_filled"),
            F.col("y").isNull().alias("is_missing"),
            *kept.values(),
        )
    )


def fill_drivers(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Forward then backward fill of named driver columns, per series."""
    return fill_both_ways(df, keys, [c for c in cols if c in df.columns])


def day_facts(panel: DataFrame) -> DataFrame:
    """``series_id, day, n_slots, n_obs``: one row per series and day."""
    return panel.groupBy("series_id", day_of(F.col("ts")).alias("day")).agg(
        F.count("*").alias("n_slots"), F.count_if(~F.col("is_missing")).alias("n_obs")
    )


def usable_days(days: DataFrame, slots_per_day: int, drop_gaps: bool = False) -> DataFrame:
    """Day facts of complete days; optionally only of days without a missing slot."""
    out = days.where(F.col("n_slots") == slots_per_day)
    return out.where(F.col("n_obs") == slots_per_day) if drop_gaps else out


def complete_days(panel: DataFrame, slots_per_day: int = 24) -> DataFrame:
    """Keep days that have all their slots. A day is at most ``slots_per_day`` rows."""
    w = Window.partitionBy("series_id", "_day")
    return (
        panel.withColumn("_day", day_of(F.col("ts")))
        .withColumn("_n", F.count("*").over(w))
        .where(F.col("_n") == slots_per_day)
        .drop("_day", "_n")
    )


def days_without_missing(panel: DataFrame) -> DataFrame:
    w = Window.partitionBy("series_id", "_day")
    return (
        panel.withColumn("_day", day_of(F.col("ts")))
        .withColumn("_m", F.count_if("is_missing").over(w))
        .where(F.col("_m") == 0)
        .drop("_day", "_m")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``: an aggregate, so it combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    ).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def capacity(panel: DataFrame, q: float = 0.999, observed_only: bool = False) -> DataFrame:
    """``series_id, capacity``: a high quantile of ``y`` with linear interpolation, by rank
    search, so that no task holds a series. By default zero-filled missing slots count."""
    if observed_only:
        panel = panel.where(~F.col("is_missing"))
    return exact_quantiles(panel, ["series_id"], "y_filled", [q]).select("series_id", F.col("value").alias("capacity"))


def attach(df: DataFrame, constants: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join per-group constants (capacity, scaler, weights) to rows; the planner
    broadcasts them when their size allows."""
    return df.join(constants, list(keys), "left")
