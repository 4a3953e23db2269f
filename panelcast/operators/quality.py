"""Data-quality audits of panels and drivers."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunks import WIDTH, runs, with_neighbours
from ..functions.sliding import trailing_quantiles
from ..functions.time import Grid, day_of, local_offset_hours, ts_of


def missing_runs(panel: DataFrame, grid: Grid) -> DataFrame:
    """``series_id, start, end, hours`` of every run of missing slots."""
    r = runs(panel, ["series_id"], F.col("is_missing"), F.col("is_missing"))
    return r.select(
        "series_id",
        ts_of(F.col("start_slot"), grid).alias("start"),
        ts_of(F.col("end_slot"), grid).alias("end"),
        F.col("n_slots").alias("hours"),
    )


def flatlines(panel: DataFrame, grid: Grid, at_least: int = 4) -> DataFrame:
    """Runs of an equal non-zero observed value of at least ``at_least`` slots."""
    r = runs(panel, ["series_id"], F.col("y"), F.col("y").isNotNull() & (F.col("y") != 0))
    return r.where(F.col("n_slots") >= at_least).select(
        "series_id",
        F.col("state").alias("value"),
        ts_of(F.col("start_slot"), grid).alias("start"),
        ts_of(F.col("end_slot"), grid).alias("end"),
        F.col("n_slots").alias("hours"),
    )


def run_summary(found: DataFrame, long_run: int = 72, mid_run: int = 10) -> DataFrame:
    h = F.col("hours")
    longer = F.when(h > long_run, h)
    return found.groupBy("series_id").agg(
        F.max(h).alias("longest_run"),
        F.count("*").alias("n_runs"),
        F.count_if(h == 1).alias("n_single"),
        F.count_if(h >= mid_run).alias("n_mid"),
        F.count_if(h > long_run).alias("n_long"),
        F.percentile(h, 0.5).alias("median_run"),
        F.percentile(longer, 0.5).alias("median_long_run"),
        (100.0 * F.sum(F.coalesce(longer, F.lit(0))) / F.sum(h)).alias("pct_in_long"),
    )


def gap_summary(panel: DataFrame, grid: Grid, slots_per_day: int, long_run: int = 72, mid_run: int = 10) -> DataFrame:
    """Rows, missing rows and days with gaps per series, and a summary of its missing runs.
    The panel is read twice (days, runs): pass a stored one."""
    days = panel.groupBy("series_id", day_of(F.col("ts")).alias("day")).agg(
        F.count("*").alias("n"), F.count_if("is_missing").alias("m")
    )
    m = F.col("m")
    totals = days.groupBy("series_id").agg(
        F.sum("n").alias("n_rows"),
        F.sum("m").alias("n_missing"),
        (100.0 * F.sum("m") / F.sum("n")).alias("pct_missing"),
        F.count("*").alias("n_days"),
        F.count_if(m > 0).alias("days_any"),
        F.count_if(m == slots_per_day).alias("days_full"),
        F.count_if((m > 0) & (m < slots_per_day)).alias("days_part"),
    )
    return totals.join(run_summary(missing_runs(panel, grid), long_run, mid_run), "series_id", "left")


def clock_changes(slots: DataFrame, grid: Grid, zone: str) -> DataFrame:
    """Slots whose local UTC offset differs from the slot before.

    Both offsets are functions of the row's own time, so no window is needed.
    """
    now = local_offset_hours(F.col("ts"), zone)
    before = local_offset_hours(ts_of(F.col("slot") - 1, grid), zone)
    return (
        slots.withColumn("offset_before", before)
        .withColumn("offset_after", now)
        .where(F.col("offset_before") != F.col("offset_after"))
    )


def spring_forward(panel: DataFrame, grid: Grid, zone: str) -> DataFrame:
    """Per series: forward clock changes in the record, how many of them are missing,
    single-slot gaps, and whether every forward change is missing.

    A series' first slot has no change before it: it is taken off again, so one pass over the
    panel counts changes. The panel is read twice (changes, runs): pass a stored one."""
    forward = local_offset_hours(F.col("ts"), zone) > local_offset_hours(ts_of(F.col("slot") - 1, grid), zone)
    gone = forward & F.col("is_missing")
    inner = lambda c: F.count_if(c) - F.min_by(c.cast("bigint"), "slot")
    changes = panel.groupBy("series_id").agg(inner(forward).alias("n_forward"), inner(gone).alias("n_forward_missing"))
    singles = missing_runs(panel, grid).groupBy("series_id").agg(
        F.count_if(F.col("hours") == 1).alias("n_single_gaps")
    )
    return (
        changes.join(singles, "series_id", "left")
        .fillna({"n_single_gaps": 0})
        .withColumn(
            "all_forward_missing",
            (F.col("n_forward") > 0) & (F.col("n_forward") == F.col("n_forward_missing")),
        )
    )


def capacity_drift(panel: DataFrame) -> DataFrame:
    """Per series: number of months and the spread of monthly maxima (sd / mean)."""
    monthly = monthly_maxima(panel)
    return monthly.groupBy("series_id").agg(
        F.count("*").alias("n_months"),
        F.avg("month_max").alias("mean_max"),
        (F.stddev_samp("month_max") / F.avg("month_max")).alias("cv"),
    )


def daily_maxima(panel: DataFrame) -> DataFrame:
    return panel.groupBy("series_id", day_of(F.col("ts")).alias("day")).agg(
        F.max("y_filled").alias("day_max")
    )


def monthly_maxima(panel: DataFrame) -> DataFrame:
    month = F.date_format("ts", "yyyy-MM").alias("month")
    return panel.groupBy("series_id", month).agg(F.max("y_filled").alias("month_max"))


def rolling_quantile(panel: DataFrame, slots: int, q: float, width: int = WIDTH) -> DataFrame:
    """``series_id, slot, rolling_q``: quantile of ``y_filled`` over the last ``slots`` slots, this
    one included. Inside a chunk, a sorted window slides: each value enters and leaves once."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot")
        found = trailing_quantiles(rows["slot"].tolist(), rows["y_filled"].tolist(), slots, q)
        return rows.assign(rolling_q=found).loc[rows["_own"], ["series_id", "slot", "rolling_q"]]

    rows = panel.where("y_filled is not null").select("series_id", "slot", F.col("y_filled").cast("double").alias("y_filled"))
    kind = f"series_id {panel.schema['series_id'].dataType.simpleString()}, slot bigint, rolling_q double"
    return with_neighbours(rows, before=slots - 1, width=width).groupBy("series_id", "_chunk").applyInPandas(run, kind)


def cell_medians(panel: DataFrame, cell: Sequence[Column]) -> DataFrame:
    """Median of observed ``y`` per series and calendar cell."""
    return (
        panel.where(~F.col("is_missing"))
        .groupBy("series_id", *cell)
        .agg(F.percentile("y", 0.5).alias("median_y"), F.count("*").alias("n"))
    )


def peak_slots(medians: DataFrame, by: str, slot: str) -> DataFrame:
    """Slot of the highest median per group; the earliest wins a tie."""
    best = F.max_by(F.col(slot), F.struct(F.col("median_y"), -F.col(slot)))
    return medians.groupBy("series_id", by).agg(
        best.alias("peak_slot"), F.max("median_y").alias("peak_median")
    )


def suspicious_zeros(panel: DataFrame, active: Column, tiny: float = 1e-3, flag_pct: float = 5.0) -> DataFrame:
    pct = 100.0 * F.avg(F.when(F.col("y") <= tiny, 1.0).otherwise(0.0))
    return (
        panel.where(~F.col("is_missing") & active)
        .groupBy("series_id", F.date_format("ts", "yyyy-MM").alias("month"))
        .agg(F.count("*").alias("n"), pct.alias("zero_pct"))
        .withColumn("flagged", F.col("zero_pct") > flag_pct)
    )


def ratio_distribution(frame: DataFrame, driver: str, active: Column, floor: float = 50.0) -> DataFrame:
    """Distribution of y over ``capacity * driver / 1000`` where the driver exceeds ``floor``."""
    k = F.col("y") / F.greatest(F.col("capacity") * F.col(driver) / 1000.0, F.lit(1e-3))
    kept = frame.where(~F.col("is_missing") & active & (F.col(driver) > floor)).select(
        "series_id", k.alias("k")
    )
    q = F.percentile("k", [0.1, 0.5, 0.9])
    return kept.groupBy("series_id").agg(
        F.count("*").alias("n"),
        F.avg("k").alias("mean_k"),
        F.stddev_pop("k").alias("sd_k"),
        (100.0 * F.avg((F.col("k") > 1.2).cast("double"))).alias("pct_high"),
        (100.0 * F.avg((F.col("k") < 0.05).cast("double"))).alias("pct_low"),
        q.getItem(0).alias("p10"),
        q.getItem(1).alias("p50"),
        q.getItem(2).alias("p90"),
    )


def clip_audit(frame: DataFrame, quantities: dict[str, Column], bound: float) -> DataFrame:
    """Per series and bounded quantity: how often and how far the raw value exceeds its bound."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(n).alias("quantity"), c.cast("double").alias("raw")) for n, c in quantities.items()])
    )
    raw = F.col("raw")
    return (
        frame.select("series_id", pairs.alias("p"))
        .select("series_id", "p.quantity", "p.raw")
        .where(raw.isNotNull() & ~F.isnan(raw))
        .groupBy("series_id", "quantity")
        .agg(
            F.count("*").alias("n"),
            F.count_if(raw > bound).alias("n_above"),
            (100.0 * F.avg((raw > bound).cast("double"))).alias("pct_above"),
            F.max(raw).alias("max_raw"),
            F.percentile(raw, 0.99).alias("p99_raw"),
            F.percentile(raw, 0.5).alias("median_raw"),
        )
        .withColumn("bound_active", F.col("n_above") > 0)
    )


def floor_share(frame: DataFrame, driver: str, bound: float, floor: float = 1.0) -> DataFrame:
    """Share of rows at the ratio's denominator floor, and of the excesses it explains."""
    env = F.greatest(F.col("capacity") * F.col(driver) / 1000.0, F.lit(floor))
    low = env <= floor * 1.001
    high = F.col("y") / env > bound
    return frame.groupBy("series_id").agg(
        F.count("*").alias("n"),
        (100.0 * F.avg(low.cast("double"))).alias("pct_at_floor"),
        (100.0 * F.count_if(low & high) / F.greatest(F.count_if(high), F.lit(1))).alias("pct_explained"),
    )


def source_agreement(a: DataFrame, b: DataFrame, variables: Sequence[str], keys: Sequence[str], active: str | None = None) -> DataFrame:
    """Per variable and subset: means, MAE, RMSE and correlation over common keys.

    Both sides have one row per key; ``active`` names a boolean column of ``a``. The
    subset tags are exploded once.
    """
    flag = [active] if active else []
    left = a.select(*keys, *flag, *[F.col(v).alias(f"a_{v}") for v in variables])
    right = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in variables])
    return agreement(left.join(right, list(keys)), variables, active=active)


def agreement(both: DataFrame, variables: Sequence[str], by: Sequence[str] = (), active: str | None = None) -> DataFrame:
    """The measures of :func:`source_agreement` on joined rows with ``a_<v>`` and ``b_<v>``,
    for each value of ``by``."""
    tags = F.array(F.lit("ALL")) if active is None else F.array_compact(
        F.array(F.lit("ALL"), F.when(F.col(active), F.lit("active")))
    )
    stacked = both.select(
        *by,
        F.explode(tags).alias("subset"),
        F.array(
            *[F.struct(F.lit(v).alias("variable"), F.col(f"a_{v}").alias("a"), F.col(f"b_{v}").alias("b")) for v in variables]
        ).alias("vs"),
    ).select(*by, "subset", F.inline("vs"))
    d = F.col("a") - F.col("b")
    return stacked.groupBy(*by, "variable", "subset").agg(
        F.count("*").alias("n"),
        F.avg("a").alias("mean_a"),
        F.avg("b").alias("mean_b"),
        F.avg(F.abs(d)).alias("mae"),
        F.sqrt(F.avg(d * d)).alias("rmse"),
        # NULL where one side is constant, as with a single pair
        F.try_divide(F.covar_pop("a", "b"), F.stddev_pop("a") * F.stddev_pop("b")).alias("correlation"),
    )


def null_counts(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows with any NULL driver, and NULL cells in total."""
    cells = sum((F.col(c).isNull().cast("bigint") for c in cols), F.lit(0))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count_if(cells > 0).alias("rows_with_null"),
        F.sum(cells).cast("bigint").alias("null_cells"),
    )

