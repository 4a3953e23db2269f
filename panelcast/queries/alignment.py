"""Time alignment of a panel with its driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import HOURLY, local_offset_hours, local_offset_slots
from ..operators import align, joins, splits
from ..operators.grid import complete_days, day_facts
from ..plans.datasets import D, H, stored_frame
from .registry import query, tidy
from .sql import metric_sql, r, sql


def _frame(spark, sf, ds=H):
    return stored_frame(spark, sf, ds)


_PAIRS = """SELECT t.series_id, t.slot, t.ts, shift, s.y, s.y_filled, t.driver, t.active, t.capacity FROM frame_h t, (SELECT unnest(range(-3, 4)) AS shift) k
    JOIN frame_h s ON s.series_id = t.series_id AND s.slot = t.slot - shift"""


@query("j09_constant_shift", sql(f"SELECT series_id, slot, shift, y, {r('driver')} AS driver FROM ({_PAIRS}) WHERE y IS NOT NULL"))
def j09_constant_shift(spark, sf):
    frame = stored_frame(spark, sf, H)
    out = joins.shifted(frame.where("y is not null").select("series_id", "slot", "y"), frame.select("series_id", "slot", "driver"), align.SHIFTS)
    return tidy(out.select("series_id", "slot", "shift", "y", "driver"))


@query(
    "a01_shift_scan",
    sql(f"SELECT series_id, shift, {metric_sql(yhat='(capacity * driver / 1000.0)', cap='capacity')} FROM ({_PAIRS}) WHERE active AND y IS NOT NULL GROUP BY ALL"),
)
def a01_shift_scan(spark, sf):
    return tidy(align.shift_scan(_frame(spark, sf)))


_LAG = """SELECT y.series_id, lag, count(*) AS n, round(corr(y.y_filled, g.driver), 9) AS r FROM frame_h y, (SELECT unnest(range(-3, 4)) AS lag) k
    JOIN frame_h g ON g.series_id = y.series_id AND g.slot = y.slot - lag WHERE y.active AND NOT y.is_missing GROUP BY ALL HAVING count(*) >= 10"""


@query(
    "a02_peak_lag",
    sql(f"SELECT series_id, lag AS peak_lag, {r('r')} AS correlation FROM ({_LAG}) QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY r DESC, lag) = 1"),
)
def a02_peak_lag(spark, sf):
    return tidy(align.peak_lag(_frame(spark, sf)))


_OFF = "date_diff('minute', {ts}, timezone('Europe/London', timezone('UTC', {ts}))) / 60"
_DPAIRS = f"""SELECT t.series_id, shift, s.y, t.driver, t.active, t.capacity, {_OFF.format(ts='t.ts')} AS off FROM frame_d t, (SELECT unnest(range(-3, 4)) AS shift) k
    JOIN frame_d s ON s.series_id = t.series_id AND s.slot = t.slot - shift"""


@query(
    "a03_shift_scan_by_period",
    sql(
        f"""SELECT * FROM (SELECT series_id, period, shift, {metric_sql(yhat='(capacity * driver / 1000.0)', digits=4)} FROM (
        SELECT *, unnest(CASE WHEN off = 1 THEN ['offset 1', 'whole record'] WHEN off = 0 THEN ['offset 0', 'whole record'] ELSE ['whole record'] END) AS period FROM ({_DPAIRS}))
        WHERE active AND y IS NOT NULL GROUP BY ALL) WHERE n >= 100"""
    ),
)
def a03_shift_scan_by_period(spark, sf):
    off = local_offset_hours(F.col("ts"), "Europe/London")
    periods = {"offset 1": off == 1, "offset 0": off == 0, "whole record": F.lit(True)}
    return tidy(align.shift_scan_by_period(_frame(spark, sf, D), periods), 4)


# series of two sites, each with a clock of its own
_ZONES = ("Europe/London", "America/New_York")
_ZONE = f"CASE WHEN series_id < 'e' THEN '{_ZONES[0]}' ELSE '{_ZONES[1]}' END"
_MOVED = f"""SELECT t.series_id, extra, s.y, t.driver, t.capacity FROM (SELECT *, date_diff('minute', ts, timezone({_ZONE}, timezone('UTC', ts))) // 60 AS off FROM frame_h WHERE active) t,
    (SELECT unnest([-2, -1, 0, 1]) AS extra) k JOIN frame_h s ON s.series_id = t.series_id AND s.slot = t.slot - (extra - off) WHERE s.y IS NOT NULL"""


def _offset():
    zone = F.when(F.col("series_id") < "e", _ZONES[0]).otherwise(_ZONES[1])
    return local_offset_slots(F.col("ts"), zone, HOURLY)


@query(
    "a04_offset_scan",
    sql(f"SELECT series_id, extra, {metric_sql(yhat='(capacity * driver / 1000.0)', cap='capacity', digits=4)} FROM ({_MOVED}) GROUP BY ALL"),
)
def a04_offset_scan(spark, sf):
    return tidy(align.offset_scan(_frame(spark, sf), _offset()), 4)


@query("j10_row_offset", sql(f"SELECT series_id, extra, count(*) AS n, {r('sum(y)', 2)} AS total, {r('sum(driver)', 2)} AS driver FROM ({_MOVED}) GROUP BY ALL"))
def j10_row_offset(spark, sf):
    frame = _frame(spark, sf).withColumn("off", _offset())
    out = joins.moved_by_row(
        frame.where("y is not null").select("series_id", "slot", "y"),
        frame.where("active").select("series_id", "slot", "driver", "off"),
        F.col("off"),
        [-2, -1, 0, 1],
    )
    return tidy(
        out.groupBy("series_id", "extra").agg(
            F.count("*").alias("n"), F.sum("y").alias("total"), F.sum("driver").alias("driver")
        ),
        2,
    )


_FOLD = f"""SELECT series_id, protocol, fold, shift, count(*) FILTER (WHERE active) AS n, max(cap) AS capacity,
    CASE WHEN count(*) FILTER (WHERE active) >= 100 THEN 1 - sum((y - cap * driver / 1000.0)**2) FILTER (WHERE active) / (var_pop(y) FILTER (WHERE active) * count(*) FILTER (WHERE active)) END AS r2
    FROM (SELECT p.*, s.protocol, s.fold, quantile_cont(y, 0.999) OVER (PARTITION BY p.series_id, s.protocol, s.fold, shift) AS cap FROM ({_PAIRS}) p
    JOIN splits_h s ON s.series_id = p.series_id AND s.day = CAST(p.ts AS DATE) AND s.role <> 'test' WHERE p.y IS NOT NULL) GROUP BY ALL"""


def _by_fold(spark, sf):
    frame = _frame(spark, sf)
    folds = splits.both_protocols(day_facts(complete_days(frame)), H.setup.rolling, H.setup.random)
    return align.shift_scan_by_fold(frame, folds)


@query("a05_shift_by_fold", sql(f"SELECT series_id, protocol, fold, shift, n, {r('capacity', 4)} AS capacity, {r('r2', 5)} AS r2 FROM ({_FOLD})"))
def a05_shift_by_fold(spark, sf):
    return tidy(_by_fold(spark, sf), 5, capacity=4)


@query(
    "a05_selected_shift",
    sql(f"SELECT series_id, protocol, fold, shift AS selected_shift, {r('r2', 5)} AS best_score FROM ({_FOLD}) WHERE r2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id, protocol, fold ORDER BY round(r2, 9) DESC, shift) = 1"),
)
def a05_selected_shift(spark, sf):
    return tidy(align.best_shift(_by_fold(spark, sf), ["series_id", "protocol", "fold"]), 5)
