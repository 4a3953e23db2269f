"""Reference forecasts, for every fold of every series at once.

What a fold learns is one row per ``series_id, protocol, fold``: its capacity and
small maps of means. Rows to be forecast are joined to that row once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.chunks import at_offset, bounded_window
from ..functions.time import Grid, season_slot
from .features import circular_window, upper_envelope, year_cells
from .joins import lookback
from .splits import fold_sums, train_rows

FOLD = ("series_id", "protocol", "fold")


def cell_key(month: Column, slot: Column) -> Column:
    return month * 1000 + slot


def with_lookback(frame: DataFrame, grid: Grid, driver: str | None = None, seasons: int = 7, missing: str = "null") -> DataFrame:
    """Adds ``prev_y``, ``prev_lag`` (exactly one season back) and, with a driver,
    ``prev_pair`` (y and driver of one past row).

    ``missing="zero"`` treats filled zeros as observations, as a pipeline that
    fills before it forecasts does; the default looks further back instead.
    """
    y = F.col("y") if missing == "null" else F.col("y_filled")
    values = {"prev_y": y}
    if driver:
        ok = y.isNotNull() & F.col(driver).isNotNull()
        values["prev_pair"] = F.when(ok, F.struct(y.alias("y"), F.col(driver).alias("g")))
    return lookback(frame, values, grid, seasons, latest={"prev_lag": F.col("y")})


def climatology_profile(assigned: DataFrame, grid: Grid) -> DataFrame:
    """Per fold: overall mean, means by season slot and by (month, season slot)."""
    by = {"_m": F.month("ts"), "_s": season_slot(F.col("slot"), grid)}
    cells = fold_sums(assigned, {"_sy": F.col("y"), "_n": F.lit(1)}, by)
    mean = F.sum("_sy") / F.sum("_n")
    slots = cells.groupBy(*FOLD, "_s").agg(
        F.sum("_sy").alias("_ssy"),
        F.sum("_n").alias("_sn"),
        mean.alias("_mean"),
        F.collect_list(
            F.struct(cell_key(F.col("_m"), F.col("_s")).alias("k"), (F.col("_sy") / F.col("_n")).alias("v"))
        ).alias("_cells"),
    )
    return slots.groupBy(*FOLD).agg(
        (F.sum("_ssy") / F.sum("_sn")).alias("clim_all"),
        F.map_from_entries(F.collect_list(F.struct("_s", "_mean"))).alias("clim_slot"),
        F.map_from_entries(F.flatten(F.collect_list("_cells"))).alias("clim_cell"),
    )


def climatology_value(month: Column, slot: Column) -> Column:
    """(month, slot) mean, else slot mean, else overall mean; floored at 0."""
    v = F.coalesce(
        F.try_element_at("clim_cell", cell_key(month, slot)),
        F.try_element_at("clim_slot", slot),
        F.col("clim_all"),
    )
    return F.greatest(v, F.lit(0.0))


def ratio_profile(assigned: DataFrame, capacities: DataFrame, grid: Grid, driver: str, bound: float | Column | None = 1.5, carry: Sequence[str] = ()) -> DataFrame:
    """Per fold: mean training ratio overall and by season slot.

    The ratio is bounded, so it depends on the fold's capacity and every fold has
    to see its rows. Capacities travel as one map per series, so copies per fold
    are made inside the map-side aggregation and are not shuffled. ``carry`` names
    columns a ``bound`` column needs.
    """
    fold_id = F.concat_ws("|", "protocol", "fold")
    caps = capacities.groupBy("series_id").agg(
        F.map_from_entries(F.collect_list(F.struct(fold_id, "capacity"))).alias("_caps")
    )
    rows = train_rows(
        assigned.select("series_id", "slot", "y", "is_missing", driver, "train_of", "eval_of", *carry).join(caps, "series_id")
    )
    r = C.ratio(F.col("y"), F.try_element_at("_caps", fold_id), F.col(driver), bound)
    slots = (
        rows.withColumns({"_r": r, "_s": season_slot(F.col("slot"), grid)})
        .groupBy(*FOLD, "_s")
        .agg(F.sum("_r").alias("_sr"), F.count("_r").alias("_n"))
    )
    return slots.groupBy(*FOLD).agg(
        (F.sum("_sr") / F.sum("_n")).alias("ratio_all"),
        F.map_from_entries(F.collect_list(F.struct("_s", F.col("_sr") / F.col("_n")))).alias("ratio_slot"),
    )


def reference_columns(grid: Grid, driver: str, bound: float | Column | None = 1.5) -> dict[str, Column]:
    """Forecast columns over rows that carry lookback values and a fold's profiles."""
    s, g, cap = season_slot(F.col("slot"), grid), F.col(driver), F.col("capacity_fold")
    clim = climatology_value(F.month("ts"), s)
    carried = C.ratio(F.col("prev_pair.y"), cap, F.col("prev_pair.g"), bound)
    k = F.coalesce(carried, F.try_element_at("ratio_slot", s), F.col("ratio_all"), F.lit(0.0))
    today = F.greatest(cap * F.coalesce(g, F.lit(0.0)) / 1000.0, F.lit(0.0))
    return {
        "Persistence": F.greatest(F.coalesce("prev_y", clim, F.lit(0.0)), F.lit(0.0)),
        "Climatology": clim,
        "SmartPersistence": F.greatest(k * today, F.lit(0.0)),
    }


def lag_forecasts(panel: DataFrame, lags: Sequence[int]) -> DataFrame:
    """Plain lags as forecasts, NULL where the slot back is missing."""
    return bounded_window(
        panel,
        ["series_id"],
        lambda w: {f"persistence_{k}": at_offset(w, "y", -k) for k in lags},
        before=max(lags),
        after=0,
    )


def in_sample_climatology(panel: DataFrame, grid: Grid) -> DataFrame:
    """Means of ``y_filled`` by season slot and by (month, season slot), on every row."""
    m, s = F.month("ts").alias("_m"), season_slot(F.col("slot"), grid).alias("_s")
    cells = panel.groupBy("series_id", m, s).agg(F.sum("y_filled").alias("_sy"), F.count("*").alias("_n"))
    slots = cells.groupBy("series_id", "_s").agg((F.sum("_sy") / F.sum("_n")).alias("clim_slot"))
    table = cells.select("series_id", "_m", "_s", (F.col("_sy") / F.col("_n")).alias("clim_cell")).join(
        slots, ["series_id", "_s"]
    )
    return (
        panel.withColumns({"_m": F.month("ts"), "_s": season_slot(F.col("slot"), grid)})
        .join(table, ["series_id", "_m", "_s"])
        .drop("_m", "_s")
    )


def year_climatology(train: DataFrame, grid: Grid, half: int = 7) -> DataFrame:
    """``series_id, season_slot, doy, clim``: mean of observed ``y`` within a circular
    day-of-year window, with the slot's mean over the table where the window is empty."""
    cells = year_cells(
        train.where(~F.col("is_missing")), grid, [F.sum("y").alias("_sy"), F.count("y").alias("_n")]
    )
    near = circular_window(
        cells, F.struct("_sy", "_n"), half, lambda c: F.sum(c["_sy"]), "_wy"
    )
    near = circular_window(near, F.col("_n"), half, F.sum, "_wn")
    mean = F.when(F.col("_wn") > 0, F.col("_wy") / F.col("_wn"))
    slot_mean = F.avg("_mean").over(Window.partitionBy("series_id", "season_slot"))
    return near.withColumn("_mean", mean).select(
        "series_id", "season_slot", "doy", F.coalesce("_mean", slot_mean).alias("clim")
    )


def at_year_cell(rows: DataFrame, table: DataFrame, grid: Grid) -> DataFrame:
    return rows.withColumns(
        {"season_slot": season_slot(F.col("slot"), grid), "doy": F.dayofyear("ts")}
    ).join(table, ["series_id", "season_slot", "doy"], "left")


def envelope_persistence(panel: DataFrame, grid: Grid, lag: int = 24, half: int = 14, q: float = 0.95) -> DataFrame:
    """Carry the ratio to a data-driven envelope ``lag`` slots ahead."""
    env = at_year_cell(panel, upper_envelope(panel, grid, half, q), grid)
    k = F.least(F.greatest(F.col("y") / F.col("envelope"), F.lit(0.0)), F.lit(1.5))
    k = F.when(F.col("y").isNotNull(), k)
    return bounded_window(
        env.withColumn("_k", k),
        ["series_id"],
        lambda w: {"_k_lag": at_offset(w, "_k", -lag)},
        before=lag,
        after=0,
    ).withColumn("yhat", F.col("_k_lag") * F.col("envelope")).drop("_k", "_k_lag")


def physics_proxy(capacity: Column, driver: Column) -> Column:
    return capacity * driver / 1000.0


def convex_mix(rows: DataFrame, a: str, b: str, keys: Sequence[str] = ("series_id", "protocol"), points: int = 201) -> DataFrame:
    """Leave-one-fold-out weight of ``w * a + (1 - w) * b`` on a grid of ``points``.

    Squared error is quadratic in w: three sums per fold are enough, "other folds"
    is total minus own, and the grid runs over one row per fold. The first minimum
    wins; a single fold gets 0.5.
    """
    keys = list(keys)
    u, v = F.col("y") - F.col(b), F.col(a) - F.col(b)
    per_fold = rows.groupBy(*keys, "fold").agg(
        F.sum(u * u).alias("_uu"), F.sum(u * v).alias("_uv"), F.sum(v * v).alias("_vv"), F.count("*").alias("_n")
    )
    others = Window.partitionBy(*keys)
    names = ("_uu", "_uv", "_vv", "_n")
    left_out = per_fold.withColumns({f"_o{n}": F.sum(n).over(others) - F.col(n) for n in names})
    step = 1.0 / (points - 1)
    w = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * F.lit(step))
    loss = lambda x: F.col("_o_uu") - 2.0 * x * F.col("_o_uv") + x * x * F.col("_o_vv")
    scored = F.transform(w, lambda x: F.struct(F.round(loss(x) / F.col("_o_n"), 9).alias("l"), x.alias("w")))
    best = F.array_min(scored)["w"]
    return left_out.select(
        *keys, "fold", F.when(F.col("_o_n") > 0, best).otherwise(0.5).alias("weight")
    )
