"""Joins of panels with drivers, forecasts and each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import at_offset, bounded_window, nearest
from ..functions.time import Grid, season_no, season_slot
from .grid import fill_drivers


#: Slots of a driver span made in one array.
SPAN = 8192


def with_drivers(panel: DataFrame, exog: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), fill: bool = True) -> DataFrame:
    """Panel left-joined to drivers on the exact slot (and ``keys``, such as a site),
    then filled forward and backward inside each series.

    A driver table has one row per key and slot; the planner broadcasts it when its
    size allows, else both sides shuffle on the slot. When the panel knows its
    spans (``first_slot, last_slot``) the fill costs the panel nothing, see
    :func:`fillable`; ``exog`` may be its stored result. A plain driver table is read
    several times and should be a stored one.
    """
    on = [*keys, "slot"]
    if not fill:
        return panel.join(exog.select(*on, *cols), on, "left")
    if "first_slot" not in panel.columns:
        return fill_drivers(panel.join(exog.select(*on, *cols), on, "left"), cols)
    lo, hi = F.min("slot").alias("_lo"), F.max("slot").alias("_hi")
    if keys:
        near = panel.join(exog.groupBy(*keys).agg(lo, hi), list(keys), "left")
    else:
        near = panel.withColumns({"_lo": exog.agg(lo).scalar(), "_hi": exog.agg(hi).scalar()})
    # a slot beyond the driver table's span looks at the nearest end
    near = near.withColumn("_at", F.least(F.greatest("slot", "_lo"), "_hi"))
    ready = all(f"_ff_{c}" in exog.columns for c in cols)
    table = exog if ready else fillable(exog, cols, keys)
    wanted = [f"_{d}_{c}" for c in cols for d in ("ff", "bf")]
    table = table.select(*keys, F.col("slot").alias("_at"), *wanted)

    def inside(entry: str) -> Column:
        return F.col(f"{entry}.slot").between(F.col("first_slot"), F.col("last_slot"))

    picked = {
        c: F.when(inside(f"_ff_{c}"), F.col(f"_ff_{c}.v")).when(inside(f"_bf_{c}"), F.col(f"_bf_{c}.v"))
        for c in cols
    }
    return near.join(table, [*keys, "_at"], "left").select(
        *[F.col(c) for c in panel.columns], *[v.alias(c) for c, v in picked.items()]
    )


def fillable(exog: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Every slot of the driver table's span with the nearest earlier and later value.

    ``_ff_<c>`` and ``_bf_<c>`` are structs of the value and the slot it comes from,
    so a series can refuse values from outside its own span. The work is done on
    the driver table, which has one row per key and slot, not on the panel.
    """
    keys = list(keys)
    spans = exog.groupBy(*keys).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    # a span is dealt out in chunks; no array is longer than one
    chunk = F.expr(f"explode(sequence(lo div {SPAN}, hi div {SPAN}))").alias("_c")
    chunks = spans.select(*keys, "lo", "hi", chunk).repartition(*keys, "_c")
    first, last = F.greatest("lo", F.col("_c") * SPAN), F.least("hi", (F.col("_c") + 1) * SPAN - 1)
    slots = chunks.select(*keys, F.explode(F.sequence(first, last)).alias("slot"))
    full = slots.join(exog.select(*keys, "slot", *cols), [*keys, "slot"], "left")
    return nearest(full, keys, cols).drop(*cols)


def pair_on(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Two configurations' forecasts on the keys they share."""
    left = a.select(*keys, "y", F.col(value).alias("yhat_a"))
    right = b.select(*keys, F.col(value).alias("yhat_b"))
    return left.join(right, list(keys))


def common_slots(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("slot",)) -> DataFrame:
    """Rows of ``a`` whose key also occurs in ``b``."""
    return a.join(b.select(*keys), list(keys), "left_semi")


def lookback(
    df: DataFrame,
    values: dict[str, Column],
    grid: Grid,
    seasons: int = 7,
    keys: Sequence[str] = ("series_id",),
    latest: dict[str, Column] | None = None,
) -> DataFrame:
    """Latest non-NULL value at the same season slot, 1..``seasons`` seasons back.

    One RANGE window over (series, season slot) instead of ``seasons`` self-joins.
    ``latest`` columns look exactly one season back.
    """
    w = Window.partitionBy(*keys, "_ss").orderBy("_sn")
    back, one = w.rangeBetween(-seasons, -1), w.rangeBetween(-1, -1)
    cols = {n: F.last(c, ignorenulls=True).over(back) for n, c in values.items()}
    cols |= {n: F.last(c).over(one) for n, c in (latest or {}).items()}
    return (
        df.withColumns(
            {"_ss": season_slot(F.col("slot"), grid), "_sn": season_no(F.col("slot"), grid)}
        )
        .withColumns(cols)
        .drop("_ss", "_sn")
    )


def observed_before(df: DataFrame, offset: int, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Rows whose slot ``offset`` earlier was observed (semi-join)."""
    seen = df.where(~F.col("is_missing")).select(*keys, (F.col("slot") + offset).alias("slot"))
    return df.join(seen, [*keys, "slot"], "left_semi")


def training_cells(assigned: DataFrame, cell: dict[str, Column]) -> DataFrame:
    """Distinct observed cells of every fold: ``in_train`` where its training rows have the
    cell; a row at all means that training or validation rows have it. Cells are found once
    per set of folds, and only those are spread."""
    member = "struct<protocol:string,fold:string,in_train:boolean>"
    trains = F.transform("train_of", lambda m: F.struct(m["protocol"].alias("protocol"), m["fold"].alias("fold"), F.lit(True).alias("in_train")).cast(member))
    checks = F.transform(F.filter("eval_of", lambda m: m["role"] == "val"), lambda m: F.struct(m["protocol"].alias("protocol"), m["fold"].alias("fold"), F.lit(False).alias("in_train")).cast(member))
    rows = assigned.where(~F.col("is_missing")).select("series_id", *[c.alias(n) for n, c in cell.items()], F.array_sort(F.concat(trains, checks)).alias("_of"))
    spread = rows.where(F.size("_of") > 0).distinct().select("series_id", *cell, F.inline("_of"))
    return spread.groupBy("series_id", "protocol", "fold", *cell).agg(F.max("in_train").alias("in_train"))


def unseen_cells(scored: DataFrame, train: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scored rows whose key never occurs in training (anti-join on distinct keys)."""
    return scored.join(train.select(*keys).distinct(), list(keys), "left_anti")


def shifted(values: DataFrame, against: DataFrame, shifts: Sequence[int], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """``values`` moved by each shift, joined to ``against`` at the new slot.

    Every shift is a row copy with a new slot, so all shifts take one shuffle.
    """
    moved = (
        values.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in shifts])))
        .withColumn("slot", F.col("slot") + F.col("shift"))
    )
    return moved.join(against, [*keys, "slot"])


def at_shifts(frame: DataFrame, source: Sequence[str], shifts: Sequence[int], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """:func:`shifted` of a frame against itself, without a join: every row meets the
    ``source`` columns of ``shift`` slots earlier, as ``src_<c>``. One shuffle of the
    rows instead of one per shift."""
    entry = F.struct(*[F.col(c).alias(f"src_{c}") for c in source])
    wide = bounded_window(
        frame,
        keys,
        lambda w: {f"_at{i}": at_offset(w, entry, -s) for i, s in enumerate(shifts)},
        before=max(*shifts, 0),
        after=max(*[-s for s in shifts], 0),
    )
    met = F.array(*[F.struct(F.lit(s).alias("shift"), F.col(f"_at{i}").alias("_src")) for i, s in enumerate(shifts)])
    return (
        wide.select(*frame.columns, F.inline(met))
        .where(F.col("_src").isNotNull())
        .select(*frame.columns, "shift", "_src.*")
    )


def moved_by_row(values: DataFrame, against: DataFrame, target_offset: Column, extras: Sequence[int], keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """For each target row and extra, the value ``extra - target_offset`` slots earlier:
    a record written ``target_offset`` slots ahead is moved back by it, plus ``extra``.

    ``target_offset`` is a column of ``against`` in slots (such as the local clock offset of
    :func:`local_offset_slots`). When clocks go back, two UTC slots have one local slot and
    both meet its record; the local slot that clocks skip is met by none.
    """
    wanted = (
        against.withColumn("extra", F.explode(F.array(*[F.lit(e) for e in extras])))
        .withColumn("target_slot", F.col("slot"))
        .withColumn("slot", (F.col("slot") - (F.col("extra") - target_offset)).cast("bigint"))
    )
    return wanted.join(values, [*keys, "slot"])


def days_to_slots(days: DataFrame, array: str, value: str) -> DataFrame:
    """Day arrays back to one row per day and hour."""
    keys = [c for c in days.columns if c != array]
    return days.select(*keys, F.posexplode(array).alias("hour", value))
