"""Grid arithmetic. All timestamps are UTC; the session zone must be UTC."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Step of a regular grid in seconds and the number of slots in one season."""

    step: int
    season: int


HOURLY = Grid(3600, 24)
DAILY = Grid(86400, 7)


def ensure_utc(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def slot_of(ts: Column, grid: Grid) -> Column:
    return F.floor(epoch_seconds(ts) / F.lit(grid.step)).cast("bigint")


def ts_of(slot: Column, grid: Grid) -> Column:
    return F.timestamp_seconds(slot * F.lit(grid.step)).cast("timestamp_ntz")


def day_of(ts: Column) -> Column:
    return ts.cast("date")


def season_slot(slot: Column, grid: Grid) -> Column:
    """Position inside the season: the hour of day on an hourly grid."""
    return F.pmod(slot, F.lit(grid.season)).cast("int")


def season_no(slot: Column, grid: Grid) -> Column:
    return F.floor(slot / F.lit(grid.season)).cast("bigint")


def local_offset_hours(ts: Column, zone: str | Column) -> Column:
    """Offset of ``zone`` (a name, or a column of names) from UTC at each UTC timestamp, in hours."""
    utc = ts.cast("timestamp")
    return (
        F.unix_seconds(F.from_utc_timestamp(utc, zone)) - F.unix_seconds(utc)
    ) / F.lit(3600.0)


def local_offset_slots(ts: Column, zone: str | Column, grid: Grid) -> Column:
    """The same in whole slots of the grid, rounded down: what to add to a UTC slot for the slot
    under which a logger on local time has filed it. Only grids of an hour or finer have one."""
    if grid.step > 3600:
        raise ValueError("a local clock offset has no slot on a grid coarser than an hour")
    return F.floor(local_offset_hours(ts, zone) * F.lit(3600.0 / grid.step)).cast("bigint")
