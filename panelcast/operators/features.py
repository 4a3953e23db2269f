"""Feature columns, day arrays, supervised windows and envelopes."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.chunks import at_offset, bounded_window
from ..functions.sliding import circular_quantiles
from ..functions.time import Grid, day_of, season_slot
from .solar import sun_position
from .splits import fold_sums

CONTEXT_SUFFIXES = ("lag1", "lead1", "roll3")
# The driver columns that get temporal context, and the solar set.
CONTEXT_COLUMNS = (
    "shortwave_radiation",
    "direct_normal_irradiance",
    "direct_radiation",
    "diffuse_radiation",
    "cloud_cover",
    "cloud_cover_low",
    "cloud_cover_mid",
    "cloud_cover_high",
    "wind_speed_10m",
    "poa_global",
    "clearness_kt",
)
SOLAR_COLUMNS = (
    "sun_zenith",
    "sun_elev",
    "cos_zenith",
    "airmass",
    "dni_extra",
    "ghi_toa_horiz",
    "clearness_kt",
    "aoi",
    "cos_aoi",
    "poa_global",
)
CYCLE_COLUMNS = ("doy_sin", "doy_cos")


def add_calendar(df: DataFrame, grid: Grid) -> DataFrame:
    return df.withColumns(C.calendar(F.col("ts"), F.col("slot"), grid))


def add_cyclic(df: DataFrame, year: bool = True, day: bool = True) -> DataFrame:
    cols: dict[str, Column] = {}
    if year:
        cols |= C.cyclic(F.dayofyear("ts"), 365.25, "doy")
    if day:
        cols |= C.cyclic(F.hour("ts"), 24.0, "hour")
    return df.withColumns(cols)


def temporal_context(df: DataFrame, cols: Sequence[str] = CONTEXT_COLUMNS, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """``_lag1``, ``_lead1`` and centred 3-slot mean for the columns present."""
    have = [c for c in cols if c in df.columns]

    def build(w):
        near = w.rangeBetween(-1, 1)
        out = {}
        for c in have:
            out[f"{c}_lag1"] = at_offset(w, c, -1)
            out[f"{c}_lead1"] = at_offset(w, c, 1)
            out[f"{c}_roll3"] = F.avg(c).over(near)
        return out

    return bounded_window(df, list(keys), build, 1, 1) if have else df


def target_lags(df: DataFrame, lags: Sequence[int] = (24, 48, 168), col: str = "y") -> DataFrame:
    return bounded_window(
        df,
        ["series_id"],
        lambda w: {f"{col}_lag{k}": at_offset(w, col, -k) for k in lags},
        before=max(lags),
        after=0,
    )


def groups_of(name: str) -> frozenset[str]:
    """Groups a feature belongs to: ``driver``, ``solar``, ``context``, ``cycle``. Context
    of a solar column is both."""
    base, _, end = name.rpartition("_")
    lagged = end in CONTEXT_SUFFIXES
    tags = {
        "context": lagged,
        "solar": (base if lagged else name) in SOLAR_COLUMNS,
        "cycle": name in CYCLE_COLUMNS,
    }
    return frozenset(g for g, holds in tags.items() if holds) or frozenset({"driver"})


def feature_names(columns: Sequence[str], drivers: Sequence[str], context: Sequence[str] = CONTEXT_COLUMNS) -> list[str]:
    """The columns that are features, in the order drivers, solar, context, yearly cycle."""
    around = (f"{c}_{s}" for c in context for s in CONTEXT_SUFFIXES)
    place = {c: i for i, c in enumerate(chain(drivers, SOLAR_COLUMNS, around, CYCLE_COLUMNS))}
    return sorted(place.keys() & set(columns), key=place.__getitem__)


def ablate(df: DataFrame, features: Sequence[str], drop: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Leave out feature groups. An hour-of-day encoding stands in for the solar group."""
    kept = [f for f in dict.fromkeys(features) if groups_of(f).isdisjoint(drop)]
    if "solar" not in drop:
        return df, kept
    return add_cyclic(df, year=False), [*kept, *(f for f in ("hour_sin", "hour_cos") if f not in kept)]


def active_by_label(panel: DataFrame, capacity: DataFrame, grid: Grid, pct: float = 0.05) -> DataFrame:
    """Mark slots whose (month, season slot) median of ``y_filled`` exceeds a share of capacity."""
    cell = [F.month("ts").alias("_m"), season_slot(F.col("slot"), grid).alias("_s")]
    med = panel.groupBy("series_id", *cell).agg(F.percentile("y_filled", 0.5).alias("_med"))
    flags = med.join(capacity, "series_id").select(
        "series_id", "_m", "_s", (F.col("_med") > pct * F.col("capacity")).alias("active")
    )
    return (
        panel.withColumns({"_m": F.month("ts"), "_s": season_slot(F.col("slot"), grid)})
        .join(flags, ["series_id", "_m", "_s"])
        .drop("_m", "_s")
    )


def active_by_elevation(df: DataFrame, lat: float, lon: float, degrees: float = 5.0) -> DataFrame:
    """Mark slots with the sun above ``degrees``; ``sun_elev`` is reused when present."""
    known = "sun_elev" in df.columns
    placed = df if known else sun_position(df, F.lit(lat), F.lit(lon))
    return placed.select(*df.columns, (F.col("sun_elev") > degrees).alias("active"))


def day_arrays(df: DataFrame, cols: dict[str, Column], keys: Sequence[str] = ("series_id",), slots: int = 24) -> DataFrame:
    """One row per key and day with an array of ``slots`` hourly values per column;
    the first value of an hour counts, an hour without a row is NULL."""
    entry = F.struct(F.hour("ts").alias("h"), *[c.cast("double").alias(n) for n, c in cols.items()])
    packed = df.groupBy(*keys, day_of(F.col("ts")).alias("day")).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    hours = F.sequence(F.lit(0), F.lit(slots - 1))

    def by_hour(name: str) -> Column:
        return F.transform(
            hours, lambda h: F.get(F.filter("_e", lambda e: e["h"] == h), F.lit(0))[name]
        ).alias(name)

    return packed.select(*keys, "day", *[by_hour(n) for n in cols])


def day_matrix(df: DataFrame, value: str, slots: int = 24) -> DataFrame:
    """Wide form: one column per hour, the first value of an hour."""
    return (
        df.groupBy("series_id", day_of(F.col("ts")).alias("day"))
        .pivot("hour", list(range(slots)))
        .agg(F.min_by(value, "slot"))
    )


def supervised_windows(
    frame: DataFrame,
    capacity: Column,
    drivers: Sequence[str] = (),
    keys: Sequence[str] = ("series_id",),
    history: int = 7,
    availability: bool = True,
    weight_missing: bool = False,
    hidden: Column | None = None,
) -> DataFrame:
    """One sample per key and day: ``history`` past days plus the target day.

    Channels are arrays of (history + 1) day arrays: scaled ``y`` (0 on the target
    day), past flag, availability (optional) and drivers. ``hidden`` marks rows
    whose ``y`` must not appear as history. Weights are 0 for a missing target,
    1 otherwise, 4 when active; ``evaluate`` is 1 for observed active targets.
    Days are taken in the order present, as samples of complete days.
    """
    keys = list(keys)
    seen = ~F.col("is_missing") if hidden is None else ~F.col("is_missing") & ~hidden
    unhidden = F.lit(True) if hidden is None else ~hidden
    scaled = F.coalesce(F.col("y_filled") / capacity, F.lit(0.0))
    observed = F.lit(1.0) if weight_missing else (~F.col("is_missing")).cast("double")
    cols = {
        "_hist": F.when(unhidden, scaled).otherwise(0.0),
        "_avail": seen.cast("double"),
        "target": scaled,
        "weight": observed * F.when(F.col("active"), 4.0).otherwise(1.0),
        "evaluate": (F.col("active") & ~F.col("is_missing")).cast("double"),
        **{f"_x_{d}": F.col(d) for d in drivers},
    }
    days = day_arrays(frame, cols, keys).withColumn(
        "slot", F.row_number().over(Window.partitionBy(*keys).orderBy("day")).cast("bigint")
    )
    zeros = F.array_repeat(F.lit(0.0), 24)
    ones = F.array_repeat(F.lit(1.0), 24)

    def build(w):
        past, block = w.rangeBetween(-history, -1), w.rangeBetween(-history, 0)
        out = {"_p": F.collect_list("_hist").over(past)}
        if availability:
            out["_a"] = F.collect_list("_avail").over(past)
        return out | {d: F.collect_list(f"_x_{d}").over(block) for d in drivers}

    wide = bounded_window(days, keys, build, before=history, after=0).where(F.size("_p") == history)
    chans = [
        F.concat("_p", F.array(zeros)).alias("pv"),
        F.concat(F.array_repeat(ones, history), F.array(zeros)).alias("past"),
    ]
    if availability:
        chans.append(F.concat("_a", F.array(zeros)).alias("available"))
    return wide.select(*keys, "day", *chans, *drivers, "target", "weight", "evaluate")


def training_statistics(assigned: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``<c>_mean, <c>_sd`` (population) of each fold's training rows."""
    sums = {}
    for c in cols:
        ok = F.col(c).isNotNull()
        sums |= {
            f"_n_{c}": F.when(ok, 1.0).otherwise(0.0),
            f"_s_{c}": F.when(ok, F.col(c)),
            f"_q_{c}": F.when(ok, F.col(c) * F.col(c)),
        }
    m = fold_sums(assigned, sums)
    out = []
    for c in cols:
        mean = F.col(f"_s_{c}") / F.col(f"_n_{c}")
        var = F.col(f"_q_{c}") / F.col(f"_n_{c}") - mean * mean
        out += [mean.alias(f"{c}_mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias(f"{c}_sd")]
    return m.select("series_id", "protocol", "fold", *out)


def standardise(frame: DataFrame, stats: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``(x - mean) / (sd + 1e-6)`` with training statistics ``<c>_mean, <c>_sd``; NULL becomes 0."""
    joined = frame.join(stats, list(keys))
    return joined.withColumns(
        {
            f"{c}_z": F.coalesce((F.col(c) - F.col(f"{c}_mean")) / (F.col(f"{c}_sd") + 1e-6), F.lit(0.0))
            for c in cols
        }
    ).drop(*[f"{c}_{s}" for c in cols for s in ("mean", "sd")])


def circular_window(
    cells: DataFrame, value: Column, half: int, agg, name: str, period: int = 366
) -> DataFrame:
    """Aggregate a (series, season slot, day-of-year) table over a circular window.

    Only the rows within ``half`` of the year's end are copied across it, so a
    window costs one pass over the table and no ``2 * half + 1``-fold blow-up.
    """
    doy = F.col("doy")
    shifts = F.array_compact(
        F.array(
            F.lit(0),
            F.when(doy <= half, F.lit(period)),
            F.when(doy > period - half, F.lit(-period)),
        )
    )
    w = (
        Window.partitionBy("series_id", "season_slot")
        .orderBy("_pos")
        .rangeBetween(-half, half)
    )
    return (
        cells.withColumn("_shift", F.explode(shifts))
        .withColumn("_pos", (doy + F.col("_shift")).cast("bigint"))
        .withColumn(name, agg(value).over(w))
        .where(F.col("_shift") == 0)
        .drop("_shift", "_pos")
    )


def year_cells(panel: DataFrame, grid: Grid, aggs: Sequence[Column], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Aggregates per (series, season slot, day of year), with a row for every day 1..366."""
    keys = list(keys)
    doy, s = F.dayofyear("ts").alias("doy"), season_slot(F.col("slot"), grid).alias("season_slot")
    cells = panel.groupBy(*keys, s, doy).agg(*aggs)
    full = (
        cells.select(*keys, "season_slot")
        .distinct()
        .withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(366))))
    )
    return full.join(cells, [*keys, "season_slot", "doy"], "left")


def upper_envelope(panel: DataFrame, grid: Grid, half: int = 14, q: float = 0.95, smooth: int = 7) -> DataFrame:
    """``series_id, season_slot, doy, envelope``: high quantile of ``y_filled`` in a
    circular day-of-year window, smoothed by a circular mean, at least 1.

    A group is a season slot of a series, with one row a day; a sorted window goes round
    the year once, so each value enters and leaves once."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        by_day: list[list[float]] = [[] for _ in range(366)]
        for day, value in zip(rows["doy"], rows["y_filled"]):
            by_day[day - 1].append(value)
        found = circular_quantiles(by_day, half, q)
        return pd.DataFrame({"series_id": rows["series_id"].iloc[0], "season_slot": rows["season_slot"].iloc[0], "doy": range(1, 367), "_q": found})

    cells = panel.where("y_filled is not null").select(
        "series_id", season_slot(F.col("slot"), grid).cast("bigint").alias("season_slot"), F.dayofyear("ts").alias("doy"), F.col("y_filled").cast("double").alias("y_filled")
    )
    kind = f"series_id {panel.schema['series_id'].dataType.simpleString()}, season_slot bigint, doy int, _q double"
    raw = cells.groupBy("series_id", "season_slot").applyInPandas(run, kind)
    return circular_window(raw, F.col("_q"), smooth, F.avg, "_sm").select(
        "series_id",
        "season_slot",
        "doy",
        F.when(F.col("_sm").isNotNull(), F.greatest("_sm", F.lit(1.0))).alias("envelope"),
    )
