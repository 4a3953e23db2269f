"""Calendar, context, solar and window features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.time import DAILY, HOURLY, local_offset_hours, slot_of, ts_of
from ..operators import features, grid, joins, solar, splits
from ..operators.grid import day_facts
from ..plans.datasets import H, stored_frame
from ..sources import tables
from .registry import query, tidy
from .sql import r, sql, sun_items


@query(
    "f01_calendar",
    sql("SELECT series_id, slot, hour(ts) AS hour, month(ts) AS month, dayofyear(ts) AS doy, isodow(ts) - 1 AS dow, slot % 24 AS season_slot FROM panel_h"),
)
def f01_calendar(spark, sf):
    out = features.add_calendar(tables.panel_h(spark, sf), HOURLY)
    return tidy(out.select("series_id", "slot", "hour", "month", "doy", "dow", "season_slot"))


@query(
    "f02_cyclic",
    sql(
        f"""SELECT series_id, slot, {r('sin(2*pi()*dayofyear(ts)/365.25)')} AS doy_sin, {r('cos(2*pi()*dayofyear(ts)/365.25)')} AS doy_cos,
        {r('sin(2*pi()*hour(ts)/24)')} AS hour_sin, {r('cos(2*pi()*hour(ts)/24)')} AS hour_cos FROM panel_h"""
    ),
)
def f02_cyclic(spark, sf):
    out = features.add_cyclic(tables.panel_h(spark, sf))
    return tidy(out.select("series_id", "slot", "doy_sin", "doy_cos", "hour_sin", "hour_cos"))


_W = "OVER (PARTITION BY series_id ORDER BY slot)"
_N = "OVER (PARTITION BY series_id ORDER BY slot ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"


@query(
    "f03_temporal_context",
    sql(
        "SELECT series_id, slot, "
        + ", ".join(
            f"{r(f'lag({c}) {_W}')} AS {c}_lag1, {r(f'lead({c}) {_W}')} AS {c}_lead1, {r(f'avg({c}) {_N}')} AS {c}_roll3"
            for c in ("n_events", "mean_value")
        )
        + " FROM frame_h"
    ),
)
def f03_temporal_context(spark, sf):
    cols = ["n_events", "mean_value", "absent_column"]
    out = features.temporal_context(stored_frame(spark, sf, H), cols)
    return tidy(out.select("series_id", "slot", *[f"{c}_{s}" for c in cols[:2] for s in features.CONTEXT_SUFFIXES]))


@query(
    "f04_target_lags",
    sql(f"SELECT series_id, slot, lag(y, 24) {_W} AS y_lag24, lag(y, 48) {_W} AS y_lag48, lag(y, 168) {_W} AS y_lag168 FROM panel_u"),
)
def f04_target_lags(spark, sf):
    return features.target_lags(tables.panel_u(spark, sf)).select("series_id", "slot", "y_lag24", "y_lag48", "y_lag168")


_SITES = f"""SELECT *, {sun_items('lat', 'lon')} FROM (SELECT n_nationkey AS site_id, -60.0 + 5.0 * n_nationkey AS lat, -170.0 + 14.0 * n_nationkey AS lon,
    10.0 + n_nationkey AS tilt, 90.0 + 7.0 * n_nationkey AS azimuth, s.slot, make_timestamp(s.slot * 3600000000) AS ts, ghi, dni
    FROM nation JOIN (SELECT c_nationkey, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS slot, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) * 10.0 AS ghi,
    CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS DOUBLE) / count(*) * 8.0 AS dni FROM events JOIN customer ON c_custkey = user_id GROUP BY 1, 2) s ON s.c_nationkey = n_nationkey)"""


def _sites(spark, sf):
    """Hourly readings per site: events placed at their customer's nation."""
    k = F.col("n_nationkey").cast("double")
    sites = tables.load(spark, sf, "nation").select(
        F.col("n_nationkey").alias("site_id"),
        (k * 5.0 - 60.0).alias("lat"),
        (k * 14.0 - 170.0).alias("lon"),
        (k + 10.0).alias("tilt"),
        (k * 7.0 + 90.0).alias("azimuth"),
    )
    events = tables.load(spark, sf, "events")
    home = tables.load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("site_id"))
    # summed per user and hour before the join, so a busy user shuffles few rows
    per_user = events.groupBy("user_id", slot_of(F.col("ts"), HOURLY).alias("slot")).agg(
        F.sum(F.col("value").cast("decimal(18,2)")).alias("v"),
        F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"),
        F.count("*").alias("n"),
    )
    mean = lambda c: F.sum(c).cast("double") / F.sum("n")
    hours = (
        per_user.join(home, "user_id")
        .groupBy("site_id", "slot")
        .agg((mean("v") * 10.0).alias("ghi"), (mean("k") * 8.0).alias("dni"))
    )
    return hours.withColumn("ts", ts_of(F.col("slot"), HOURLY)).join(sites, "site_id")


@query(
    "f05_sun_position",
    sql(f"SELECT site_id::BIGINT AS site_id, slot, {r('sun_zenith', 5)} AS sun_zenith, {r('sun_elev', 5)} AS sun_elev, {r('sun_az', 4)} AS sun_az, {r('cos_zenith')} AS cos_zenith FROM ({_SITES})"),
)
def f05_sun_position(spark, sf):
    out = solar.sun_position(_sites(spark, sf))
    return tidy(out.select("site_id", "slot", "sun_zenith", "sun_elev", "sun_az", "cos_zenith"), 5, sun_az=4, cos_zenith=6)


@query(
    "f06_airmass",
    sql(f"SELECT site_id::BIGINT AS site_id, slot, {r('CASE WHEN sun_zenith < 90 THEN 1.0/(cos(radians(sun_zenith)) + 0.50572*power(96.07995 - sun_zenith, -1.6364)) ELSE 40.0 END')} AS airmass FROM ({_SITES})"),
)
def f06_airmass(spark, sf):
    return tidy(solar.sun_position(_sites(spark, sf)).select("site_id", "slot", "airmass"))


_B = "2*pi()/365.0*(dayofyear(ts) - 1)"
_IRR = f"""SELECT *, 1366.1*(1.00011 + 0.034221*cos({_B}) + 0.00128*sin({_B}) + 0.000719*cos(2*{_B}) + 0.000077*sin(2*{_B})) AS dni_extra,
    dni_extra*greatest(cos_zenith, 0.0) AS ghi_toa_horiz,
    least(greatest(CASE WHEN ghi_toa_horiz > 50 THEN ghi/greatest(ghi_toa_horiz, 1.0) ELSE 0.0 END, 0.0), 1.5) AS clearness_kt,
    degrees(acos(greatest(-1.0, least(1.0, cos(radians(tilt))*cos(radians(sun_zenith)) + sin(radians(tilt))*sin(radians(sun_zenith))*cos(radians(sun_az - azimuth)))))) AS aoi,
    greatest(cos(radians(aoi)), 0.0) AS cos_aoi,
    greatest(ghi - dni*greatest(cos_zenith, 0.0), 0.0) AS dhi,
    greatest(dni*cos_aoi, 0.0) + dhi*(1 + cos(radians(tilt)))/2 + ghi*0.25*(1 - cos(radians(tilt)))/2 AS poa_global FROM ({_SITES})"""


def _irradiance(spark, sf):
    return solar.irradiance(solar.sun_position(_sites(spark, sf)), "ghi", "dni")


@query("f07_extraterrestrial", sql(f"SELECT site_id::BIGINT AS site_id, slot, {r('dni_extra', 5)} AS dni_extra, {r('ghi_toa_horiz', 5)} AS ghi_toa_horiz FROM ({_IRR})"))
def f07_extraterrestrial(spark, sf):
    return tidy(_irradiance(spark, sf).select("site_id", "slot", "dni_extra", "ghi_toa_horiz"), 5)


@query("f08_clearness", sql(f"SELECT site_id::BIGINT AS site_id, slot, {r('clearness_kt')} AS clearness_kt FROM ({_IRR})"))
def f08_clearness(spark, sf):
    return tidy(_irradiance(spark, sf).select("site_id", "slot", "clearness_kt"))


@query("f09_incidence", sql(f"SELECT site_id::BIGINT AS site_id, slot, {r('aoi', 5)} AS aoi, {r('cos_aoi')} AS cos_aoi FROM ({_IRR})"))
def f09_incidence(spark, sf):
    return tidy(_irradiance(spark, sf).select("site_id", "slot", "aoi", "cos_aoi"), 6, aoi=5)


@query("f10_plane_irradiance", sql(f"SELECT site_id::BIGINT AS site_id, slot, {r('poa_global', 5)} AS poa_global FROM ({_IRR})"))
def f10_plane_irradiance(spark, sf):
    return tidy(_irradiance(spark, sf).select("site_id", "slot", "poa_global"), 5)


@query("f11_active_by_elevation", sql("SELECT p.series_id, p.slot, sun_elev > 5.0 AS active FROM panel_h p JOIN sun_h s ON s.slot = p.slot"))
def f11_active_by_elevation(spark, sf):
    out = features.active_by_elevation(tables.panel_h(spark, sf), 50.91, -1.40)
    return out.select("series_id", "slot", "active")


@query("f12_active_by_label", sql("SELECT series_id, slot, active FROM frame_d"))
def f12_active_by_label(spark, sf):
    panel = tables.panel_d(spark, sf)
    return features.active_by_label(panel, grid.capacity(panel), DAILY, 0.4).select("series_id", "slot", "active")


@query(
    "f13_ratio",
    sql(
        f"""SELECT series_id, slot, {r('CASE WHEN y IS NOT NULL THEN least(greatest(y/greatest(capacity*driver/1000.0, 1.0), 0.0), 1.0) END')} AS ratio,
        {r('CASE WHEN y IS NOT NULL THEN greatest(y/greatest(capacity*driver/1000.0, 1.0), 0.0) END')} AS ratio_open FROM frame_h"""
    ),
)
def f13_ratio(spark, sf):
    frame = stored_frame(spark, sf, H)
    args = F.col("y"), F.col("capacity"), F.col("driver")
    return tidy(
        frame.select(
            "series_id", "slot", C.ratio(*args, 1.0).alias("ratio"), C.ratio(*args, float("inf")).alias("ratio_open")
        )
    )


@query(
    "f14_day_matrix",
    sql("SELECT series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, " + ", ".join(f"max(y) FILTER (WHERE hour(ts) = {h}) AS h{h}" for h in range(24)) + " FROM panel_h GROUP BY ALL"),
)
def f14_day_matrix(spark, sf):
    hours = tables.panel_h(spark, sf).withColumn("hour", F.hour("ts"))
    wide = features.day_matrix(hours, "y").withColumnsRenamed({str(h): f"h{h}" for h in range(24)})
    return wide.withColumn("day", F.col("day").cast("string"))


_F15 = """SELECT d.series_id, d.day, p.day AS pday, p.hidden FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM days_h) d
    JOIN (SELECT *, isodow(day) = 7 AS hidden, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i FROM days_h) p
    ON p.series_id = d.series_id AND p.i BETWEEN d.i - 7 AND d.i WHERE d.i > 7"""


@query(
    "f15_supervised_windows",
    sql(
        f"""SELECT w.series_id, CAST(w.day AS VARCHAR) AS day, 8 AS n_days,
        {r('sum(CASE WHEN w.pday < w.day AND NOT w.hidden THEN x.y_filled/capacity ELSE 0.0 END)')} AS pv_sum,
        168.0 AS past_sum, sum(CASE WHEN w.pday < w.day AND NOT w.hidden AND NOT x.is_missing THEN 1.0 ELSE 0.0 END)::DOUBLE AS available_sum,
        {r('sum(x.driver)')} AS driver_sum,
        {r('sum(CASE WHEN w.pday = w.day THEN x.y_filled/capacity ELSE 0.0 END)')} AS target_sum,
        sum(CASE WHEN w.pday = w.day AND NOT x.is_missing THEN CASE WHEN x.active THEN 4.0 ELSE 1.0 END ELSE 0.0 END)::DOUBLE AS weight_sum,
        sum(CASE WHEN w.pday = w.day AND NOT x.is_missing AND x.active THEN 1.0 ELSE 0.0 END)::DOUBLE AS evaluate_sum
        FROM ({_F15}) w JOIN whole_h x ON x.series_id = w.series_id AND x.day = w.pday GROUP BY w.series_id, w.day"""
    ),
)
def f15_supervised_windows(spark, sf):
    frame = stored_frame(spark, sf, H)
    hidden = F.weekday("ts") == 6
    out = features.supervised_windows(grid.complete_days(frame), F.col("capacity"), ["driver"], hidden=hidden)
    total = lambda c: F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + x)
    deep = lambda c: F.aggregate(F.flatten(c), F.lit(0.0), lambda a, x: a + x)
    return tidy(
        out.select(
            "series_id",
            "day",
            F.size("pv").alias("n_days"),
            deep("pv").alias("pv_sum"),
            deep("past").alias("past_sum"),
            deep("available").alias("available_sum"),
            deep("driver").alias("driver_sum"),
            total("target").alias("target_sum"),
            total("weight").alias("weight_sum"),
            total("evaluate").alias("evaluate_sum"),
        )
    )


@query(
    "f16_standardise",
    sql(
        f"""SELECT s.protocol, s.fold, s.series_id, count(*) AS n, {r('avg((w.n_events - m)/(sd + 1e-6))')} AS mean_z, {r('stddev_pop((w.n_events - m)/(sd + 1e-6))')} AS sd_z
        FROM (SELECT protocol, fold, series_id, avg(n_events) AS m, stddev_pop(n_events) AS sd FROM train_h GROUP BY ALL) s
        JOIN whole_h w ON w.series_id = s.series_id GROUP BY ALL"""
    ),
)
def f16_standardise(spark, sf):
    frame = grid.complete_days(stored_frame(spark, sf, H))
    folds = splits.both_protocols(day_facts(frame), H.setup.rolling, H.setup.random)
    stats = features.training_statistics(splits.assign(frame, folds), ["n_events"])
    out = features.standardise(frame.select("series_id", "slot", "n_events"), stats, ["n_events"], ["series_id"])
    return tidy(
        out.groupBy("protocol", "fold", "series_id").agg(
            F.count("*").alias("n"), F.avg("n_events_z").alias("mean_z"), F.stddev_pop("n_events_z").alias("sd_z")
        )
    )


ENVELOPE_SQL = """SELECT series_id, s, doy, greatest(avg(q), 1.0) AS env FROM (
    SELECT t.series_id, t.s, t.doy, q.q FROM (SELECT DISTINCT series_id, slot % 7 AS s, d.doy FROM panel_d, (SELECT unnest(range(1, 367)) AS doy) d) t
    JOIN (SELECT t.series_id, t.s, t.doy, quantile_cont(p.y_filled, 0.95) AS q
      FROM (SELECT DISTINCT series_id, slot % 7 AS s, d.doy FROM panel_d, (SELECT unnest(range(1, 367)) AS doy) d) t
      JOIN panel_d p ON p.series_id = t.series_id AND p.slot % 7 = t.s AND least((dayofyear(p.ts) - t.doy + 732) % 366, (t.doy - dayofyear(p.ts) + 732) % 366) <= 14 GROUP BY ALL) q
    ON q.series_id = t.series_id AND q.s = t.s AND least((q.doy - t.doy + 732) % 366, (t.doy - q.doy + 732) % 366) <= 7) GROUP BY ALL"""


@query("f17_upper_envelope", sql(f"SELECT series_id, s AS season_slot, doy, {r('env', 4)} AS envelope FROM ({ENVELOPE_SQL})"))
def f17_upper_envelope(spark, sf):
    return tidy(features.upper_envelope(tables.panel_d(spark, sf), DAILY).where("envelope is not null"), 4)


@query(
    "f18_ablation",
    sql(f"SELECT series_id, slot, {r('n_events')} AS n_events, {r('sin(2*pi()*hour(ts)/24)')} AS hour_sin, {r('cos(2*pi()*hour(ts)/24)')} AS hour_cos FROM frame_h"),
)
def f18_ablation(spark, sf):
    frame = features.temporal_context(stored_frame(spark, sf, H), ["n_events"]).withColumn("sun_elev", F.lit(0.0))
    names = ["n_events", "n_events_lag1", "n_events_lead1", "n_events_roll3", "sun_elev", "n_events"]
    out, kept = features.ablate(frame, names, ["solar", "context"])
    return tidy(out.select("series_id", "slot", *kept))


@query(
    "f19_bins",
    sql(
        f"""SELECT series_id, CASE WHEN k > 0 AND k <= 0.2 THEN 'low' WHEN k > 0.2 AND k <= 0.6 THEN 'mid' WHEN k > 0.6 AND k <= 5 THEN 'high' END AS label,
        CASE WHEN k > 0 AND k <= 1.2 THEN ceil(k * 10)::BIGINT END AS bin, count(*) AS n FROM (SELECT series_id, y / greatest(capacity, 1.0) AS k FROM frame_h WHERE y IS NOT NULL) GROUP BY ALL"""
    ),
)
def f19_bins(spark, sf):
    panel = tables.panel_h(spark, sf)
    k = F.col("y") / F.greatest("capacity", F.lit(1.0))
    out = grid.attach(panel, grid.capacity(panel), ["series_id"]).where("y is not null").select(
        "series_id",
        C.labelled_bins(k, [0.0, 0.2, 0.6, 5.0], ["low", "mid", "high"]).alias("label"),
        C.equal_bins(k, 0.0, 1.2, 12).cast("bigint").alias("bin"),
    )
    return out.groupBy("series_id", "label", "bin").agg(F.count("*").alias("n"))


@query(
    "f20_local_offset",
    sql(
        """SELECT series_id, date_diff('minute', ts, timezone('Europe/London', timezone('UTC', ts))) / 60.0 AS offset_hours, count(*) AS n,
        min(ts) AS first_ts, max(ts) AS last_ts FROM panel_d GROUP BY ALL"""
    ),
)
def f20_local_offset(spark, sf):
    return (
        tables.panel_d(spark, sf)
        .groupBy("series_id", local_offset_hours(F.col("ts"), "Europe/London").alias("offset_hours"))
        .agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    )


@query(
    "j11_days_to_slots",
    sql("SELECT series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, hour(ts) AS hour, y FROM panel_h WHERE y IS NOT NULL"),
)
def j11_days_to_slots(spark, sf):
    days = features.day_arrays(tables.panel_h(spark, sf), {"a": F.col("y")})
    rows = joins.days_to_slots(days, "a", "y").where("y is not null")
    return rows.select("series_id", F.col("day").cast("string").alias("day"), F.col("hour").cast("bigint").alias("hour"), "y")
