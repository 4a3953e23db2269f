"""Scores of stored forecasts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.stage import shared_folder, stage
from ..functions.time import HOURLY
from ..operators import grid, metrics as M
from ..operators.joins import lookback, pair_on
from ..operators.reference import in_sample_climatology
from ..plans.datasets import D, H, stored_forecasts, stored_frame
from ..sources import tables
from ..sources.results import read_run, write_run
from .registry import query, tidy
from .sql import metric_sql, r, sql

MODELS = ["Persistence", "Climatology", "SmartPersistence", "Scaled", "OLS2"]


def test_rows(spark, sf, ds=H):
    return stored_forecasts(spark, sf, ds).where(F.col("role") == "test")


def pred(spark, sf, ds=H):
    return M.to_long(test_rows(spark, sf, ds), MODELS)


_KEY = "series_id, protocol, model"


@query("x01_metric_set", sql(f"SELECT {_KEY}, {metric_sql(cap='capacity')} FROM obs_h GROUP BY ALL"))
def x01_metric_set(spark, sf):
    return tidy(M.score(pred(spark, sf), ["series_id", "protocol", "model"], F.col("capacity")))


@query("x02_pooled_metrics", sql(f"SELECT {_KEY}, subset, {metric_sql(cap='capacity')} FROM sub_h GROUP BY ALL"))
def x02_pooled_metrics(spark, sf):
    return tidy(M.score(M.with_subsets(pred(spark, sf)), ["series_id", "protocol", "model", "subset"], F.col("capacity")))


@query(
    "x03_fold_metrics",
    sql(f"SELECT {_KEY}, fold, subset, {metric_sql(cap='capacity')} FROM sub_h GROUP BY ALL UNION ALL SELECT {_KEY}, 'ALL', subset, {metric_sql(cap='capacity')} FROM sub_h GROUP BY ALL"),
)
def x03_fold_metrics(spark, sf):
    return tidy(M.score_pooled_and_by_fold(pred(spark, sf), F.col("capacity")))


_ONCE = "SELECT *, unnest(CASE WHEN active THEN ['ALL', 'active'] ELSE ['ALL'] END) AS subset FROM (SELECT * FROM obs_d QUALIFY row_number() OVER (PARTITION BY series_id, protocol, model, ts ORDER BY fold) = 1)"


@query(
    "x04_month_metrics",
    sql(f"SELECT * FROM (SELECT {_KEY}, strftime(ts, '%Y-%m') AS month, subset, {metric_sql(cap='capacity', digits=4)} FROM ({_ONCE}) GROUP BY ALL) WHERE n >= 5"),
)
def x04_month_metrics(spark, sf):
    return tidy(M.score_by_month(pred(spark, sf, D), F.col("capacity")), 4)


_X02 = f"SELECT {_KEY}, subset, count(*) AS n, sqrt(avg((y - yhat)**2)) AS rmse, avg(abs(y - yhat)) AS mae FROM sub_h GROUP BY ALL"


def _scores(spark, sf, ds=H):
    return M.score(M.with_subsets(pred(spark, sf, ds)), ["series_id", "protocol", "model", "subset"], F.col("capacity"))


@query(
    "x05_skill",
    sql(f"SELECT {_KEY}, subset, {r('1 - rmse / max(rmse) FILTER (WHERE model = $$SmartPersistence$$) OVER (PARTITION BY series_id, protocol, subset)')} AS skill FROM ({_X02})"),
)
def x05_skill(spark, sf):
    out = M.add_skill(_scores(spark, sf), "SmartPersistence", ["series_id", "protocol", "subset"])
    return tidy(out.select("series_id", "protocol", "model", "subset", "skill"))


_PAIRS = [(a, b) for i, a in enumerate(MODELS) for b in MODELS[i:]]


@query(
    "x06_residual_correlation",
    sql(
        "SELECT series_id, protocol, m.* FROM (SELECT series_id, protocol, "
        + ", ".join(f"corr(y - {a}, y - {b}) AS {a}_{b}" for a, b in _PAIRS)
        + " FROM test_h WHERE active AND NOT is_missing GROUP BY ALL), LATERAL (SELECT unnest(["
        + ", ".join(f"'{a}'" for a in MODELS for b in MODELS)
        + "]) AS model_a, unnest(["
        + ", ".join(f"'{b}'" for a in MODELS for b in MODELS)
        + "]) AS model_b, unnest(["
        + ", ".join(r("1.0" if a == b else (f"{a}_{b}" if (a, b) in _PAIRS else f"{b}_{a}")) for a in MODELS for b in MODELS)
        + "]) AS correlation) m"
    ),
)
def x06_residual_correlation(spark, sf):
    return tidy(M.residual_correlation(test_rows(spark, sf), MODELS, ["series_id", "protocol"]))


@query(
    "x07_run_summary",
    sql(
        f"""SELECT protocol, model, subset, {r('avg(rmse)')} AS rmse_mean, {r('avg(mae)')} AS mae_mean, {r('stddev_samp(rmse)')} AS rmse_sd, {r('stddev_samp(mae)')} AS mae_sd,
        count(DISTINCT series_id) AS n_runs, {r('1 - avg(rmse) / max(avg(rmse)) FILTER (WHERE model = $$SmartPersistence$$) OVER (PARTITION BY protocol, subset)')} AS skill FROM ({_X02}) GROUP BY protocol, model, subset"""
    ).replace("FILTER (WHERE model = $$SmartPersistence$$) OVER", "FILTER (WHERE model = $$SmartPersistence$$) OVER"),
)
def x07_run_summary(spark, sf):
    runs = M.summarise_runs(_scores(spark, sf), ["protocol", "model", "subset"], ["rmse", "mae"], "series_id")
    return tidy(M.add_skill(runs, "SmartPersistence", ["protocol", "subset"], rmse="rmse_mean"))


@query(
    "x10_ensemble_gain",
    sql(
        f"""SELECT a.series_id, a.protocol, a.subset, {r('b.rmse - a.rmse')} AS abs_rmse_gain, {r('(b.rmse - a.rmse) / b.rmse * 100')} AS rel_rmse_gain_pct
        FROM ({_X02}) a JOIN ({_X02}) b ON b.series_id = a.series_id AND b.protocol = a.protocol AND b.subset = a.subset WHERE a.model = 'OLS2' AND b.model = 'Persistence'"""
    ),
)
def x10_ensemble_gain(spark, sf):
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("rmse")))
    keys = ["series_id", "protocol", "subset"]
    both = _scores(spark, sf).groupBy(*keys).agg(pick("OLS2").alias("a"), pick("Persistence").alias("b"))
    return tidy(both.select(*keys, *[c.alias(n) for n, c in M.gain(F.col("a"), F.col("b")).items()]))


@query("x18_best_model", sql(f"SELECT series_id, protocol, subset, model, n, {r('rmse')} AS rmse FROM ({_X02}) QUALIFY row_number() OVER (PARTITION BY series_id, protocol, subset ORDER BY rmse, model) = 1"))
def x18_best_model(spark, sf):
    best = M.best_per_group(_scores(spark, sf), ["series_id", "protocol", "subset"])
    return tidy(best.select("series_id", "protocol", "subset", "model", "n", "rmse"))


@query("x21_error_by_hour", sql(f"SELECT {_KEY}, hour(ts) AS hour, count(*) AS n, {r('avg(abs(y - yhat))')} AS mae FROM obs_h GROUP BY ALL"))
def x21_error_by_hour(spark, sf):
    return tidy(M.error_by_hour(pred(spark, sf)))


@query(
    "x22_error_by_bin",
    sql(f"SELECT {_KEY}, ceil(driver * 12 / 1200.0)::BIGINT AS bin, count(*) AS n, {r('avg(abs(y - yhat))')} AS mae, {r('(bin - 0.5) * 100.0')} AS centre FROM obs_h WHERE driver > 0 AND driver <= 1200 GROUP BY ALL"),
)
def x22_error_by_bin(spark, sf):
    return tidy(M.error_by_bin(pred(spark, sf), F.col("driver"), 0.0, 1200.0, 12))


_COND = "CASE WHEN k > 0 AND k <= 0.2 THEN 'low' WHEN k > 0.2 AND k <= 0.6 THEN 'mid' WHEN k > 0.6 AND k <= 5 THEN 'high' END"


@query(
    "x23_residual_table",
    sql(
        f"""SELECT {_KEY}, condition, count(*) AS n, {r('avg(y - yhat)')} AS bias, {r('sqrt(avg((y - yhat)**2))')} AS rmse, {r('avg(y)')} AS mean_y,
        {r('sqrt(avg((y - yhat)**2)) / max(capacity) * 100')} AS nrmse_pct FROM (SELECT *, {_COND} AS condition FROM (SELECT *, y / greatest(capacity * driver / 1000.0, 1e-3) AS k FROM obs_h)) WHERE condition IS NOT NULL GROUP BY ALL"""
    ),
)
def x23_residual_table(spark, sf):
    k = F.col("y") / F.greatest(F.col("capacity") * F.col("driver") / 1000.0, F.lit(1e-3))
    cond = C.labelled_bins(k, [0.0, 0.2, 0.6, 5.0], ["low", "mid", "high"])
    return tidy(M.residual_table(pred(spark, sf), cond, F.col("capacity"), ["series_id", "protocol", "model"]))


_WEEK = f"""SELECT {_KEY}, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, sqrt(avg((y - yhat)**2) FILTER (WHERE active)) AS rmse FROM obs_h
    GROUP BY ALL HAVING count(*) >= 40 AND count(*) FILTER (WHERE active) >= 10"""


@query(
    "x24_representative_week",
    sql(
        f"""SELECT {_KEY}, CAST(week AS VARCHAR) AS week, n, {r('rmse')} AS rmse, n_weeks FROM (SELECT *, median(rmse) OVER (PARTITION BY {_KEY}) AS med, count(*) OVER (PARTITION BY {_KEY}) AS n_weeks FROM ({_WEEK}))
        QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY round(abs(rmse - med), 9), week) = 1"""
    ),
)
def x24_representative_week(spark, sf):
    return tidy(M.representative_week(pred(spark, sf), ["series_id", "protocol", "model"], 40, 10))


@query(
    "x25_day_extremes",
    sql(
        f"""SELECT {_KEY}, CAST(arg_min(day, (mae, day)) AS VARCHAR) AS easiest, CAST(arg_min(day, (round(abs(mae - med), 9), day)) AS VARCHAR) AS typical,
        CAST(arg_min(day, (-mae, day)) AS VARCHAR) AS hardest, count(*) AS n_days FROM (SELECT *, median(mae) OVER (PARTITION BY {_KEY}) AS med FROM (
        SELECT {_KEY}, day, round(avg(abs(y - yhat)), 9) AS mae FROM obs_h GROUP BY ALL)) GROUP BY ALL"""
    ),
)
def x25_day_extremes(spark, sf):
    return tidy(M.day_extremes(pred(spark, sf), ["series_id", "protocol", "model"]))


@query(
    "x26_autocorrelation",
    sql(
        f"""SELECT a.series_id, lag, count(*) AS n, {r('CASE WHEN count(*) > 100 AND max(v) > 0 THEN avg((a.y - m) * (b.y - m)) / max(v) ELSE 0 END')} AS acf
        FROM panel_h a JOIN (SELECT series_id, avg(y) AS m, var_pop(y) AS v FROM panel_h GROUP BY 1) s ON s.series_id = a.series_id, (SELECT unnest(range(0, 201)) AS lag) l
        JOIN panel_h b ON b.series_id = a.series_id AND b.slot = a.slot - lag WHERE a.y IS NOT NULL AND b.y IS NOT NULL GROUP BY ALL"""
    ),
)
def x26_autocorrelation(spark, sf):
    return tidy(M.autocorrelation(tables.panel_h(spark, sf), 200))


@query(
    "x27_period_power",
    sql(
        f"""SELECT p.series_id, period, count(*) AS n, {r('(sum((y - m) * cos(2*pi()*(slot % period)/period))**2 + sum((y - m) * sin(2*pi()*(slot % period)/period))**2) / count(*)**2')} AS power
        FROM panel_h p JOIN (SELECT series_id, avg(y) AS m FROM panel_h GROUP BY 1) s ON s.series_id = p.series_id, (SELECT unnest([12, 24, 168, 720]::BIGINT[]) AS period)
        WHERE y IS NOT NULL GROUP BY ALL"""
    ),
)
def x27_period_power(spark, sf):
    return tidy(M.period_power(tables.panel_h(spark, sf), [12, 24, 168, 720]))


@query(
    "x28_convention_gap",
    sql(
        f"""SELECT series_id, model, {", ".join(f"{r(f'max({c}) FILTER (WHERE subset = $${s}$$)')} AS {n}_{t}" for c, n in (('r2', 'r2'), ('nrmse', 'nrmse')) for s, t in (('ALL', 'all'), ('active', 'active')))},
        {r("max(r2) FILTER (WHERE subset = 'ALL') - max(r2) FILTER (WHERE subset = 'active')")} AS r2_gap FROM (
        SELECT series_id, model, subset, 1 - sum((y - yhat)**2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - yhat)**2)) / max(capacity) * 100 AS nrmse FROM (
        SELECT *, unnest(CASE WHEN active THEN ['ALL', 'active'] ELSE ['ALL'] END) AS subset FROM (
        SELECT series_id, y, active, capacity, is_missing, unnest(['persistence', 'climatology']) AS model, unnest([coalesce(p, 0), c]) AS yhat FROM (
        SELECT f.*, last_value(y IGNORE NULLS) OVER (PARTITION BY series_id, slot % 24 ORDER BY slot // 24 RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS p,
        avg(y_filled) OVER (PARTITION BY series_id, month(ts), slot % 24) AS c FROM frame_h f)) WHERE NOT is_missing) GROUP BY ALL) GROUP BY ALL"""
    ),
)
def x28_convention_gap(spark, sf):
    frame = stored_frame(spark, sf, H)
    back = lookback(frame, {"persistence": F.col("y")}, HOURLY, seasons=1)
    wide = in_sample_climatology(back, HOURLY).select(
        "series_id", "y", "active", "is_missing", "capacity",
        F.coalesce("persistence", F.lit(0.0)).alias("persistence"), F.col("clim_cell").alias("climatology"),
    )
    rows = M.with_subsets(M.observed(M.to_long(wide, ["persistence", "climatology"])))
    scored = rows.groupBy("series_id", "model", "subset").agg(*M.metric_columns(capacity=F.col("capacity")))
    return tidy(M.convention_gap(scored, ["series_id", "model"]))


@query(
    "x29_drift_check",
    sql(
        f"""SELECT coalesce(e.series_id, a.series_id) AS series_id, coalesce(e.model, a.model) AS model, {r('e.v')} AS expected, {r('a.v')} AS computed,
        CASE WHEN a.v IS NULL THEN 'not computed' WHEN e.v IS NULL THEN 'not expected' WHEN abs(e.v - a.v) <= 10.0 THEN 'ok' ELSE 'mismatch' END AS verdict FROM
        (SELECT series_id, model, rmse AS v FROM ({_X02}) WHERE protocol = 'rolling_origin' AND subset = 'ALL' AND model <> 'OLS2') e FULL JOIN
        (SELECT series_id, model, rmse AS v FROM ({_X02}) WHERE protocol = 'random_day' AND subset = 'ALL' AND model <> 'Scaled') a ON a.series_id = e.series_id AND a.model = e.model"""
    ),
)
def x29_drift_check(spark, sf):
    s = _scores(spark, sf).where(F.col("subset") == "ALL")
    one = lambda p, skip: s.where((F.col("protocol") == p) & (F.col("model") != skip))
    return tidy(M.drift_check(one("rolling_origin", "OLS2"), one("random_day", "Scaled"), ["series_id", "model"], "rmse", 10.0))


_RERUN = f"SELECT * FROM ({_X02}) WHERE subset = 'ALL' AND NOT (model = 'Climatology' AND series_id = 'view')"


@query(
    "x29_drift_by_run",
    sql(
        f"""SELECT coalesce(e.series_id, a.series_id) AS series_id, coalesce(e.protocol, a.protocol) AS protocol, coalesce(e.model, a.model) AS model, run,
        {r('e.v')} AS expected, {r('a.v')} AS computed, CASE WHEN a.v IS NULL THEN 'not computed' WHEN e.v IS NULL THEN 'not expected' WHEN abs(e.v - a.v) <= 1e-6 THEN 'ok' ELSE 'mismatch' END AS verdict
        FROM (SELECT series_id, protocol, model, rmse AS v, unnest(['changed', 'same']) AS run FROM ({_X02}) WHERE subset = 'ALL') e
        LEFT JOIN (SELECT series_id, protocol, model, rmse AS v, 'same' AS run FROM ({_X02}) WHERE subset = 'ALL'
          UNION ALL SELECT series_id, protocol, model, CASE WHEN model = 'Scaled' AND series_id = 'click' THEN rmse + 1 ELSE rmse END, 'changed' FROM ({_RERUN})) a USING (series_id, protocol, model, run)"""
    ),
)
def x29_drift_by_run(spark, sf):
    """Runs against the expectations that an earlier run stored: one that repeats it, and one with
    a changed score and without another."""
    path = f"{shared_folder(spark)}/panelcast/expectations-{uuid.uuid4().hex}"
    keys = ["series_id", "protocol", "model"]
    scores = stage(_scores(spark, sf).where("subset = 'ALL'").select(*keys, "rmse"), "scores")
    off = (F.col("model") == "Scaled") & (F.col("series_id") == "click")
    gone = (F.col("model") == "Climatology") & (F.col("series_id") == "view")
    runs = {"expected": scores, "same": scores, "changed": scores.where(~gone).withColumn("rmse", F.when(off, F.col("rmse") + 1).otherwise(F.col("rmse")))}
    for run, table in runs.items():
        write_run(table, path, run)
    expected = read_run(spark, path, "expected")
    parts = [M.drift_check(expected, read_run(spark, path, run), keys, "rmse", 1e-6).withColumn("run", F.lit(run)) for run in ("same", "changed")]
    return tidy(parts[0].unionByName(parts[1]))


@query(
    "x30_sweep_spread",
    sql(
        f"""SELECT series_id, protocol, model, {r('rmse')} AS rmse, {r('max(rmse) OVER w - min(rmse) OVER w')} AS spread, {r('rmse - max(rmse) FILTER (WHERE model = $$Persistence$$) OVER w')} AS change
        FROM ({_X02}) WHERE subset = 'active' WINDOW w AS (PARTITION BY series_id, protocol)"""
    ),
)
def x30_sweep_spread(spark, sf):
    s = _scores(spark, sf).where(F.col("subset") == "active").select("series_id", "protocol", "model", "rmse")
    return tidy(M.sweep_spread(s, ["series_id", "protocol"], "model", "rmse", "Persistence"))


@query(
    "x31_two_by_two",
    sql(
        f"""SELECT series_id, {r('tt - ft')} AS effect_with, {r('tf - ff')} AS effect_without, {r('tt - ft - tf + ff')} AS interaction FROM (SELECT series_id,
        max(rmse) FILTER (WHERE protocol = 'rolling_origin' AND model = 'OLS2') AS tt, max(rmse) FILTER (WHERE protocol = 'rolling_origin' AND model = 'Scaled') AS tf,
        max(rmse) FILTER (WHERE protocol <> 'rolling_origin' AND model = 'OLS2') AS ft, max(rmse) FILTER (WHERE protocol <> 'rolling_origin' AND model = 'Scaled') AS ff
        FROM ({_X02}) WHERE subset = 'ALL' GROUP BY 1)"""
    ),
)
def x31_two_by_two(spark, sf):
    s = _scores(spark, sf).where((F.col("subset") == "ALL") & F.col("model").isin("OLS2", "Scaled"))
    s = s.withColumns({"a": F.col("protocol") == "rolling_origin", "b": F.col("model") == "OLS2"})
    return tidy(M.two_by_two(s, ["series_id"], "a", "b", "rmse"))


@query(
    "x32_subset_pivot",
    sql(f"SELECT {_KEY}, {r('max(rmse) FILTER (WHERE subset = $$ALL$$)')} AS all_rmse, {r('max(rmse) FILTER (WHERE subset = $$active$$)')} AS active_rmse FROM ({_X02}) GROUP BY ALL"),
)
def x32_subset_pivot(spark, sf):
    out = M.pivot_scores(_scores(spark, sf), ["series_id", "protocol", "model"], "subset", "rmse", ["ALL", "active"])
    return tidy(out.withColumnsRenamed({"ALL": "all_rmse", "active": "active_rmse"}))


@query(
    "x33_density",
    sql(f"SELECT {_KEY}, floor(y / (capacity / 40))::BIGINT AS x_cell, floor(yhat / (capacity / 40))::BIGINT AS y_cell, count(*) AS n FROM obs_h GROUP BY ALL"),
)
def x33_density(spark, sf):
    return M.density(pred(spark, sf), ["series_id", "protocol", "model"], F.col("capacity") / 40.0)


@query(
    "x34_histogram",
    sql("SELECT series_id, least(floor(k / 0.025), 79)::BIGINT AS bin, count(*) AS n FROM (SELECT series_id, y / greatest(capacity * driver / 1000.0, 1.0) AS k FROM frame_h WHERE y IS NOT NULL) WHERE k BETWEEN 0 AND 2 GROUP BY ALL"),
)
def x34_histogram(spark, sf):
    frame = stored_frame(spark, sf, H)
    k = C.ratio(F.col("y"), F.col("capacity"), F.col("driver"), None)
    return M.histogram(frame.where("y is not null"), k, ["series_id"]).withColumn("bin", F.col("bin").cast("bigint"))


@query(
    "j02_pair_configurations",
    sql(f"SELECT a.series_id, a.slot, {r('a.y')} AS y, {r('a.Persistence')} AS yhat_a, {r('b.OLS2')} AS yhat_b FROM test_h a JOIN test_h b ON b.series_id = a.series_id AND b.slot = a.slot WHERE a.protocol = 'rolling_origin' AND b.protocol = 'random_day'"),
)
def j02_pair_configurations(spark, sf):
    rows = test_rows(spark, sf)
    one = lambda p, m: rows.where(F.col("protocol") == p).select("series_id", "slot", "y", F.col(m).alias("yhat"))
    return tidy(pair_on(one("rolling_origin", "Persistence"), one("random_day", "OLS2"), ["series_id", "slot"], "yhat"))


@query(
    "j08_merge_results",
    sql(f"SELECT x.series_id, x.protocol, x.model, {r('x.rmse')} AS rmse, {r('c.capacity')} AS capacity, {r('100 * x.rmse / c.capacity')} AS nrmse_pct FROM ({_X02}) x LEFT JOIN cap_h c ON c.series_id = x.series_id WHERE subset = 'ALL'"),
)
def j08_merge_results(spark, sf):
    s = _scores(spark, sf).where(F.col("subset") == "ALL").select("series_id", "protocol", "model", "rmse")
    merged = grid.attach(s, grid.capacity(tables.panel_h(spark, sf)), ["series_id"])
    return tidy(merged.withColumn("nrmse_pct", 100.0 * F.col("rmse") / F.col("capacity")))
