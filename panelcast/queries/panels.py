"""Sources, gridding, quality audits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.stage import shared_folder
from ..functions.time import DAILY, HOURLY, season_slot, ts_of
from ..operators import grid, joins, quality
from ..operators.features import active_by_elevation
from ..operators.metrics import to_long
from ..plans.datasets import D, H, stored_as, stored_forecasts, stored_frame
from ..sources import exogenous, measurements, results, tables
from .registry import query, rnd, tidy
from .sql import fill, r, sql


@query(
    "s01_long_scan",
    sql(
        f"""SELECT user_id::VARCHAR AS series_id, count(*) AS n, count(TRY_CAST(props->>'$.k' AS DOUBLE)) AS n_value,
        min(ts) AS first_ts, max(ts) AS last_ts, {r("sum(CAST(TRY_CAST(props->>'$.k' AS DOUBLE) AS DECIMAL(18,2)))::DOUBLE", 2)} AS total
        FROM events WHERE event_type = 'click' GROUP BY 1"""
    ),
)
def s01_long_scan(spark, sf):
    raw = tables.load(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k"))
    kept = measurements.keep_field(raw, "click", F.col("user_id"), "ts", "event_type", "k")
    return kept.groupBy("series_id").agg(
        F.count("*").alias("n"),
        F.count("value").alias("n_value"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        rnd(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 2).alias("total"),
    )


@query(
    "s02_variable_set",
    sql(f"SELECT slot, {r('mean_value')} AS shortwave_radiation, {r('mean_k')} AS cloud_cover FROM exog_h"),
)
def s02_variable_set(spark, sf):
    wide = tables.exog_h(spark, sf).select(
        "slot",
        F.col("mean_value").alias("shortwave_radiation"),
        F.col("mean_k").alias("cloud_cover"),
        F.col("n_events").alias("cloud_cover_low"),
    )
    return tidy(exogenous.project_variables(wide, "forecast_matched", ["slot"]))


@query("s03_strip_suffix", sql(f"SELECT slot, n_orders, {r('mean_price')} AS mean_price FROM exog_d"))
def s03_strip_suffix(spark, sf):
    late = tables.exog_d(spark, sf).withColumnsRenamed(
        {c: f"{c}_previous_day1" for c in ("n_orders", "mean_price")}
    )
    return tidy(exogenous.strip_suffix(late, "_previous_day1"))


@query(
    "s04_provenance",
    sql(
        """SELECT source, first_ts, last_ts, n_rows, n_null, n IS NOT NULL AS source_ok, span_ok, coalesce(n = n_rows, false) AS rows_ok, n IS NOT NULL AND span_ok AS usable
        FROM (SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n_rows,
            count(*) FILTER (WHERE n_orders IS NULL) + count(*) FILTER (WHERE mean_price IS NULL) AS n_null,
            min(ts) <= (SELECT min(ts) FROM panel_d) AND max(ts) >= (SELECT max(ts) FROM panel_d) AS span_ok
            FROM (SELECT make_timestamp(slot * 86400000000) AS ts, * FROM exog_d)) t,
        (SELECT 'orders_daily' AS source, count(DISTINCT o_orderdate) AS n FROM orders UNION ALL SELECT 'shipments_daily', count(DISTINCT l_shipdate) FROM lineitem UNION ALL SELECT 'returns_daily', NULL) m"""
    ),
)
def s04_provenance(spark, sf):
    exog = tables.exog_d(spark, sf).withColumn("ts", ts_of(F.col("slot"), DAILY))
    days = lambda t, c, s: tables.load(spark, sf, t).agg(F.count_distinct(c).alias("n_rows")).withColumn("source", F.lit(s))
    manifest = days("orders", "o_orderdate", "orders_daily").unionByName(days("lineitem", "l_shipdate", "shipments_daily"))
    span = tables.load(spark, sf, "lineitem").agg(F.min("l_shipdate").alias("start"), F.max("l_shipdate").alias("end"))
    one = lambda s: exogenous.provenance(exog, manifest, s, span, ["n_orders", "mean_price"])
    return one("orders_daily").unionByName(one("shipments_daily")).unionByName(one("returns_daily"))


_FACTS = f"""SELECT protocol, fold, series_id, ts, model, {r("y")} AS y, {r("yhat")} AS yhat, active, is_missing FROM pred_h"""


@query("s05_prediction_facts", sql(_FACTS))
def s05_prediction_facts(spark, sf):
    wide = stored_forecasts(spark, sf, H).where(F.col("role") == "test")
    long = to_long(wide, ["Persistence", "Climatology", "SmartPersistence", "Scaled", "OLS2"])
    return tidy(
        results.prediction_facts([long]).drop("role", "slot")
    )


@query("s06_run_sink", sql("SELECT 'a' AS run, series_id, count(*) AS n FROM panel_d GROUP BY ALL UNION ALL SELECT 'b', series_id, count(*) FROM panel_d WHERE is_missing GROUP BY ALL"))
def s06_run_sink(spark, sf):
    path = f"{shared_folder(spark)}/panelcast/runs-{uuid.uuid4().hex}"
    counts = lambda df: df.groupBy("series_id").agg(F.count("*").alias("n"))
    panel = tables.panel_d(spark, sf)
    results.write_run(counts(panel.where(F.col("y").isNull())), path, "b")
    results.write_run(counts(panel.where(F.col("y").isNotNull())), path, "a")
    results.write_run(counts(panel), path, "a")
    return spark.read.parquet(path).select("run", "series_id", "n")


_PANEL_COLS = "series_id, slot, ts, y, y_filled, is_missing"


@query(
    "q01_relabel",
    sql("SELECT series_id, slot - 1 AS slot, CAST(sum(v) AS DOUBLE) AS y FROM raw_h GROUP BY series_id, slot"),
)
def q01_relabel(spark, sf):
    moved = grid.relabel(tables.readings_h(spark, sf), -1)
    return moved.groupBy("series_id", "slot").agg(F.sum("v").cast("double").alias("y"))


@query("q02_regular_grid", sql(f"SELECT {_PANEL_COLS} FROM panel_h"))
def q02_regular_grid(spark, sf):
    return tables.panel_h(spark, sf)


@query(
    "q02_regular_grid_users",
    sql(f"SELECT series_id, count(*) AS n, count(y) AS n_obs, min(ts) AS first_ts, max(ts) AS last_ts, {r('sum(CAST(y AS DECIMAL(18,2)))::DOUBLE', 2)} AS total FROM panel_u GROUP BY 1"),
)
def q02_regular_grid_users(spark, sf):
    return tables.panel_u(spark, sf).groupBy("series_id").agg(
        F.count("*").alias("n"),
        F.count("y").alias("n_obs"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        rnd(F.sum(F.col("y").cast("decimal(18,2)")).cast("double"), 2).alias("total"),
    )


@query(
    "q03_missing_flag",
    sql(f"SELECT series_id, count(*) AS n, count(*) FILTER (WHERE is_missing) AS n_missing, {r('sum(y_filled)', 2)} AS total, min(y_filled) AS low FROM panel_d GROUP BY 1"),
)
def q03_missing_flag(spark, sf):
    out = tables.panel_d(spark, sf).groupBy("series_id").agg(
        F.count("*").alias("n"),
        F.count_if("is_missing").alias("n_missing"),
        rnd(F.sum("y_filled"), 2).alias("total"),
        F.min("y_filled").alias("low"),
    )
    return out


@query("q04_complete_days", sql(f"SELECT {_PANEL_COLS} FROM panel_h QUALIFY count(*) OVER (PARTITION BY series_id, CAST(ts AS DATE)) = 24"))
def q04_complete_days(spark, sf):
    return grid.complete_days(tables.panel_h(spark, sf))


@query(
    "q05_days_without_missing",
    sql(f"SELECT {_PANEL_COLS} FROM panel_h QUALIFY count(*) FILTER (WHERE is_missing) OVER (PARTITION BY series_id, CAST(ts AS DATE)) = 0"),
)
def q05_days_without_missing(spark, sf):
    return grid.days_without_missing(tables.panel_h(spark, sf))


def _runs_sql(x: str, step: int) -> str:
    return f"""SELECT series_id, make_timestamp(min(slot) * {step}000000) AS start, make_timestamp(max(slot) * {step}000000) AS "end", count(*) AS hours
    FROM (SELECT series_id, slot, slot - row_number() OVER (PARTITION BY series_id ORDER BY slot) AS grp FROM panel_{x} WHERE is_missing) GROUP BY series_id, grp"""


@query("q06_missing_runs", sql(_runs_sql("h", 3600)))
def q06_missing_runs(spark, sf):
    return quality.missing_runs(tables.panel_h(spark, sf), HOURLY)


@query("q06_missing_runs_users", sql(f"SELECT series_id, count(*) AS n_runs, max(hours) AS longest, sum(hours)::BIGINT AS total FROM ({_runs_sql('u', 3600)}) GROUP BY 1"))
def q06_missing_runs_users(spark, sf):
    found = quality.missing_runs(tables.panel_u(spark, sf), HOURLY)
    return found.groupBy("series_id").agg(
        F.count("*").alias("n_runs"), F.max("hours").alias("longest"), F.sum("hours").alias("total")
    )


@query(
    "q07_gap_summary",
    sql(
        f"""SELECT t.*, r.* EXCLUDE (series_id) FROM (SELECT series_id, sum(n)::BIGINT AS n_rows, sum(m)::BIGINT AS n_missing,
        {r('100.0 * sum(m) / sum(n)')} AS pct_missing, count(*) AS n_days, count(*) FILTER (WHERE m > 0) AS days_any,
        count(*) FILTER (WHERE m = 24) AS days_full, count(*) FILTER (WHERE m > 0 AND m < 24) AS days_part
        FROM (SELECT series_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (WHERE is_missing) AS m FROM panel_u GROUP BY ALL) GROUP BY 1) t
        LEFT JOIN (SELECT series_id, max(hours) AS longest_run, count(*) AS n_runs, count(*) FILTER (WHERE hours = 1) AS n_single,
        count(*) FILTER (WHERE hours >= 10) AS n_mid, count(*) FILTER (WHERE hours > 72) AS n_long, median(hours) AS median_run,
        median(hours) FILTER (WHERE hours > 72) AS median_long_run,
        {r('100.0 * coalesce(sum(hours) FILTER (WHERE hours > 72), 0) / sum(hours)')} AS pct_in_long
        FROM ({_runs_sql('u', 3600)}) GROUP BY 1) r ON r.series_id = t.series_id"""
    ),
)
def q07_gap_summary(spark, sf):
    return tidy(quality.gap_summary(stored_as(spark, sf, "panel-u", lambda: tables.panel_u(spark, sf)), HOURLY, 24))


_ZONE = "Europe/London"


def _offset(ts: str) -> str:
    return f"date_diff('minute', {ts}, timezone('{_ZONE}', timezone('UTC', {ts}))) / 60.0"


@query(
    "q08_clock_changes",
    sql(
        f"""SELECT series_id, slot, ts, {_offset("ts - INTERVAL 1 DAY")} AS offset_before, {_offset("ts")} AS offset_after FROM panel_d
        WHERE {_offset("ts - INTERVAL 1 DAY")} <> {_offset("ts")}"""
    ),
)
def q08_clock_changes(spark, sf):
    return quality.clock_changes(tables.panel_d(spark, sf), DAILY, _ZONE).select(
        "series_id", "slot", "ts", "offset_before", "offset_after"
    )


@query(
    "q09_spring_forward",
    sql(
        f"""SELECT s.series_id, coalesce(n_forward, 0) AS n_forward, coalesce(n_forward_missing, 0) AS n_forward_missing,
        coalesce(n_single_gaps, 0) AS n_single_gaps, coalesce(n_forward, 0) > 0 AND n_forward = n_forward_missing AS all_forward_missing
        FROM span_d s LEFT JOIN (SELECT p.series_id, count(*) AS n_forward, count(*) FILTER (WHERE is_missing) AS n_forward_missing FROM panel_d p JOIN span_d USING (series_id)
        WHERE slot > lo AND {_offset("ts - INTERVAL 1 DAY")} < {_offset("ts")} GROUP BY 1) c ON c.series_id = s.series_id
        LEFT JOIN (SELECT series_id, count(*) FILTER (WHERE hours = 1) AS n_single_gaps FROM ({_runs_sql('d', 86400)}) GROUP BY 1) g ON g.series_id = s.series_id"""
    ),
)
def q09_spring_forward(spark, sf):
    return quality.spring_forward(stored_as(spark, sf, "panel-d", lambda: tables.panel_d(spark, sf)), DAILY, _ZONE)


@query(
    "q10_fill_drivers",
    sql(f"SELECT series_id, slot, {r(fill('y'))} AS y_fill FROM panel_u"),
)
def q10_fill_drivers(spark, sf):
    panel = tables.panel_u(spark, sf).select("series_id", "slot", F.col("y").alias("y_fill"))
    return tidy(grid.fill_drivers(panel, ["y_fill"]))


@query(
    "q11_first_per_key",
    sql("SELECT series_id, ts, protocol, fold FROM test_d QUALIFY row_number() OVER (PARTITION BY series_id, ts ORDER BY protocol, fold) = 1"),
)
def q11_first_per_key(spark, sf):
    rows = stored_forecasts(spark, sf, D).where(F.col("role") == "test").select("series_id", "ts", "protocol", "fold")
    return grid.first_per_key(rows, ["series_id", "ts"], ["protocol", "fold"])


@query("q12_capacity", sql(f"SELECT series_id, {r('capacity')} AS capacity FROM cap_h"))
def q12_capacity(spark, sf):
    return tidy(grid.capacity(tables.panel_h(spark, sf)))


@query("q12_capacity_ranked", sql(f"SELECT series_id, {r('quantile_cont(y, 0.999)')} AS capacity FROM panel_u WHERE NOT is_missing GROUP BY 1"))
def q12_capacity_ranked(spark, sf):
    return tidy(grid.capacity(tables.panel_u(spark, sf), observed_only=True))


@query(
    "q13_capacity_drift",
    sql(
        f"""SELECT series_id, count(*) AS n_months, {r('avg(month_max)', 4)} AS mean_max, {r('stddev_samp(month_max) / avg(month_max)')} AS cv
        FROM (SELECT series_id, strftime(ts, '%Y-%m') AS month, max(y_filled) AS month_max FROM panel_d GROUP BY ALL) GROUP BY 1"""
    ),
)
def q13_capacity_drift(spark, sf):
    return tidy(quality.capacity_drift(tables.panel_d(spark, sf)), mean_max=4)


@query(
    "q13_rolling_quantile",
    sql(
        f"""SELECT series_id, slot, {r('quantile_cont(y_filled, 0.99) OVER (PARTITION BY series_id ORDER BY slot RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)', 4)} AS rolling_q
        FROM panel_d"""
    ),
)
def q13_rolling_quantile(spark, sf):
    out = quality.rolling_quantile(tables.panel_d(spark, sf), 30, 0.99)
    return tidy(out.select("series_id", "slot", "rolling_q"), 4)


@query("q13_daily_maxima", sql("SELECT series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, max(y_filled) AS day_max FROM panel_h GROUP BY ALL"))
def q13_daily_maxima(spark, sf):
    return quality.daily_maxima(tables.panel_h(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query(
    "q14_typical_profile",
    sql(
        f"""SELECT series_id, m, {", ".join(f"{r(f'max(med) FILTER (WHERE s = {i})')} AS s{i}" for i in range(7))}, arg_max(s, (med, -s)) AS peak_slot, {r('max(med)')} AS peak_median
        FROM (SELECT series_id, month(ts) AS m, slot % 7 AS s, median(y) AS med FROM panel_d WHERE NOT is_missing GROUP BY ALL) GROUP BY ALL"""
    ),
)
def q14_typical_profile(spark, sf):
    cell = [F.month("ts").alias("m"), season_slot(F.col("slot"), DAILY).alias("s")]
    med = quality.cell_medians(tables.panel_d(spark, sf), cell)
    wide = med.groupBy("series_id", "m").pivot("s", list(range(7))).agg(F.max("median_y"))
    wide = wide.withColumnsRenamed({str(i): f"s{i}" for i in range(7)})
    return tidy(wide.join(quality.peak_slots(med, "m", "s"), ["series_id", "m"]))


@query(
    "q15_suspicious_zeros",
    sql(
        f"""SELECT series_id, strftime(ts, '%Y-%m') AS month, count(*) AS n, {r('100.0 * avg(CASE WHEN y <= 50000 THEN 1.0 ELSE 0.0 END)')} AS zero_pct,
        100.0 * avg(CASE WHEN y <= 50000 THEN 1.0 ELSE 0.0 END) > 5 AS flagged FROM frame_d WHERE NOT is_missing AND active GROUP BY ALL"""
    ),
)
def q15_suspicious_zeros(spark, sf):
    return tidy(quality.suspicious_zeros(stored_frame(spark, sf, D), F.col("active"), tiny=50000.0))


@query(
    "q16_ratio_distribution",
    sql(
        f"""SELECT series_id, count(*) AS n, {r('avg(k)')} AS mean_k, {r('stddev_pop(k)')} AS sd_k, {r('100.0 * avg((k > 1.2)::INT)')} AS pct_high,
        {r('100.0 * avg((k < 0.05)::INT)')} AS pct_low, {r('quantile_cont(k, 0.1)')} AS p10, {r('quantile_cont(k, 0.5)')} AS p50, {r('quantile_cont(k, 0.9)')} AS p90
        FROM (SELECT series_id, y / greatest(capacity * driver / 1000.0, 1e-3) AS k FROM frame_h WHERE NOT is_missing AND active AND driver > 50) GROUP BY 1"""
    ),
)
def q16_ratio_distribution(spark, sf):
    frame = stored_frame(spark, sf, H)
    return tidy(quality.ratio_distribution(frame, "driver", F.col("active")))


_Q17 = """SELECT series_id, unnest(['kappa', 'share']) AS quantity, unnest([y / greatest(capacity * driver / 1000.0, 1.0), y / capacity]) AS raw
    FROM frame_h WHERE NOT is_missing AND active"""


@query(
    "q17_clip_audit",
    sql(
        f"""SELECT series_id, quantity, count(*) AS n, count(*) FILTER (WHERE raw > 0.6) AS n_above, {r('100.0 * avg((raw > 0.6)::INT)')} AS pct_above,
        {r('max(raw)')} AS max_raw, {r('quantile_cont(raw, 0.99)')} AS p99_raw, {r('median(raw)')} AS median_raw, count(*) FILTER (WHERE raw > 0.6) > 0 AS bound_active
        FROM ({_Q17}) GROUP BY ALL"""
    ),
)
def q17_clip_audit(spark, sf):
    frame = stored_frame(spark, sf, H)
    quantities = {
        "kappa": C.ratio(F.col("y"), F.col("capacity"), F.col("driver"), None),
        "share": F.col("y") / F.col("capacity"),
    }
    return tidy(quality.clip_audit(frame.where("active and not is_missing"), quantities, 0.6))


@query(
    "q17_floor_share",
    sql(
        f"""SELECT series_id, count(*) AS n, {r('100.0 * avg((env <= 150.15)::INT)')} AS pct_at_floor,
        {r('100.0 * count(*) FILTER (WHERE env <= 150.15 AND y / env > 1.0) / greatest(count(*) FILTER (WHERE y / env > 1.0), 1)')} AS pct_explained
        FROM (SELECT *, greatest(capacity * driver / 1000.0, 150.0) AS env FROM frame_h WHERE NOT is_missing AND active) GROUP BY 1"""
    ),
)
def q17_floor_share(spark, sf):
    frame = stored_frame(spark, sf, H)
    return tidy(quality.floor_share(frame.where("active and not is_missing"), "driver", 1.0, 150.0))


@query(
    "q18_source_agreement",
    sql(
        f"""SELECT source, other, variable, subset, count(*) AS n, {r('avg(a)')} AS mean_a, {r('avg(b)')} AS mean_b, {r('avg(abs(a - b))')} AS mae,
        {r('sqrt(avg((a - b) * (a - b)))')} AS rmse, {r('corr(a, b)')} AS correlation FROM (
        SELECT source, other, unnest(CASE WHEN sun_elev > 5 THEN ['ALL', 'active'] ELSE ['ALL'] END) AS subset, variable, a, b FROM (
        SELECT x.series_id AS source, y.series_id AS other, s.sun_elev, unnest(['total', 'n']) AS variable, unnest([x.total, x.n]) AS a, unnest([y.total, y.n]) AS b
        FROM (SELECT series_id, slot, sum(v)::DOUBLE AS total, count(*)::DOUBLE AS n FROM raw_h GROUP BY ALL) x
        JOIN (SELECT series_id, slot, sum(v)::DOUBLE AS total, count(*)::DOUBLE AS n FROM raw_h GROUP BY ALL) y ON y.slot = x.slot AND y.series_id > x.series_id
        JOIN sun_h s ON s.slot = x.slot)) GROUP BY ALL"""
    ),
)
def q18_source_agreement(spark, sf):
    """All pairs of sources, each pair once."""
    by_slot = tables.readings_h(spark, sf).groupBy("series_id", "slot").agg(
        F.sum("v").cast("double").alias("total"), F.count("*").cast("double").alias("n")
    )
    one = lambda name, tag: by_slot.select("slot", F.col("series_id").alias(name), F.col("total").alias(f"{tag}_total"), F.col("n").alias(f"{tag}_n"))
    left = active_by_elevation(one("source", "a").withColumn("ts", ts_of(F.col("slot"), HOURLY)), 50.91, -1.40)
    both = left.join(one("other", "b"), "slot").where("source < other")
    return tidy(quality.agreement(both, ["total", "n"], ["source", "other"], "active"))


@query(
    "q19_null_counts",
    sql(
        """SELECT series_id, count(*) AS n_rows, count(*) FILTER (WHERE n_orders IS NULL OR mean_price IS NULL OR y IS NULL) AS rows_with_null,
        (count(*) FILTER (WHERE n_orders IS NULL) + count(*) FILTER (WHERE mean_price IS NULL) + count(*) FILTER (WHERE y IS NULL))::BIGINT AS null_cells
        FROM panel_d p LEFT JOIN exog_d e ON e.slot = p.slot GROUP BY 1"""
    ),
)
def q19_null_counts(spark, sf):
    cols = ["n_orders", "mean_price"]
    joined = joins.with_drivers(tables.panel_d(spark, sf), tables.exog_d(spark, sf), cols, fill=False)
    return quality.null_counts(joined, [*cols, "y"], ["series_id"])


@query(
    "q20_flatlines",
    sql(
        """SELECT series_id, v AS value, make_timestamp(min(slot) * 3600000000) AS start, make_timestamp(max(slot) * 3600000000) AS "end", count(*) AS hours FROM (
        SELECT series_id, slot, v, slot - row_number() OVER (PARTITION BY series_id, v ORDER BY slot) AS grp
        FROM (SELECT series_id, slot, round(y / 400.0) AS v FROM panel_h WHERE NOT is_missing) WHERE v <> 0) GROUP BY series_id, v, grp HAVING count(*) >= 4"""
    ),
)
def q20_flatlines(spark, sf):
    coarse = tables.panel_h(spark, sf).withColumn("y", F.round(F.col("y") / 400.0))
    return quality.flatlines(coarse, HOURLY)


@query(
    "j01_left_join_fill",
    sql(
        f"""SELECT series_id, p.slot, is_missing, {r(fill('n_orders').replace('PARTITION BY series_id ORDER BY slot', 'PARTITION BY series_id ORDER BY p.slot'))} AS n_orders,
        {r(fill('mean_price').replace('PARTITION BY series_id ORDER BY slot', 'PARTITION BY series_id ORDER BY p.slot'))} AS mean_price
        FROM panel_d p LEFT JOIN exog_d e ON e.slot = p.slot"""
    ),
)
def j01_left_join_fill(spark, sf):
    out = joins.with_drivers(tables.panel_d(spark, sf), tables.exog_d(spark, sf), ["n_orders", "mean_price"])
    return tidy(out.select("series_id", "slot", "is_missing", "n_orders", "mean_price"))


@query("j03_common_slots", sql("SELECT series_id, count(*) AS n FROM panel_d WHERE slot IN (SELECT slot FROM exog_d) GROUP BY 1"))
def j03_common_slots(spark, sf):
    common = joins.common_slots(tables.panel_d(spark, sf), tables.exog_d(spark, sf))
    return common.groupBy("series_id").agg(F.count("*").alias("n"))
