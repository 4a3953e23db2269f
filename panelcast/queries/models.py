"""Model fits and experiment grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stage import stage
from ..functions.time import HOURLY
from ..operators import fold_models, fusion, grid, linear, metrics as M, splits
from ..operators.features import ablate, add_cyclic, temporal_context
from ..operators.solar import sun_position
from ..plans import backtest, grids, masks
from ..plans.datasets import H, LAT, LON, hourly_frame, stored_all_fused, stored_as, stored_boosted, stored_drivers, stored_forecasts, stored_frame, stored_fused, stored_rows
from ..plans.products import Configuration, of_product, variants, with_products
from ..sources import tables
from .registry import query, tidy
from .scores import MODELS
from .sql import metric_sql, r, ridge1, ridge2, sql

_FOLD = "series_id, protocol, fold"
_F = ["series_id", "protocol", "fold"]


@query("m01_through_origin", sql(f"SELECT {_FOLD}, {r('slope')} AS slope FROM fit_h"))
def m01_through_origin(spark, sf):
    return tidy(linear.through_origin(stored_rows(spark, sf, H), "n_events"))


@query("m02_two_driver_ols", sql(f"SELECT {_FOLD}, {r('b0')} AS b0, {r('b1')} AS b1, {r('b2')} AS b2 FROM fit_h"))
def m02_two_driver_ols(spark, sf):
    return tidy(linear.two_driver_ols(stored_rows(spark, sf, H), "n_events", "mean_value"))


@query(
    "m03_ridge",
    sql(f"SELECT {_FOLD}, n_train::DOUBLE AS n_train, {r('w0')} AS w0, {r('w1')} AS w1, {r('w2')} AS w2 FROM ({ridge2('train_h', 'n_events', 'mean_k', _FOLD)})"),
)
def m03_ridge(spark, sf):
    fit = linear.ridge(stored_rows(spark, sf, H), ["n_events", "mean_k"])
    return tidy(fit.select(*_F, F.col("n_train").cast("double").alias("n_train"), *[F.get("coef", F.lit(i)).alias(f"w{i}") for i in range(3)]))


@query("m03_ridge_wide")
def m03_ridge_wide(spark, sf):
    """Ridge on every feature: drivers, their temporal context and calendar cycles."""
    rows = stored_rows(spark, sf, H)
    names = ["n_events", "mean_value", "mean_k", *_context(rows), "doy_sin", "doy_cos", "hour_sin", "hour_cos"]
    fit = linear.ridge(rows, names)
    test = splits.eval_rows(rows).where(F.col("role") == "test").join(fit, _F)
    scored = M.with_subsets(M.observed(test.withColumn("yhat", linear.linear_value(names))))
    return tidy(scored.groupBy("series_id", "protocol", "subset").agg(*M.metric_columns(capacity=F.col("capacity"))))


def _context(rows) -> list[str]:
    return [c for c in rows.columns if c.endswith(("_lag1", "_lead1", "_roll3"))]


_HOURFIT = ridge2("train_h", "n_events", "mean_k", "series_id, protocol, fold, hour(ts)").replace("SELECT series_id, protocol, fold, hour(ts),", "SELECT series_id, protocol, fold, hour(ts) AS h,")


@query(
    "m06_per_hour_ridge",
    sql(
        f"""SELECT t.protocol, t.fold, t.series_id, t.slot, {r('CASE WHEN f.n_train >= 12 THEN greatest(w0 + w1*t.n_events + w2*t.mean_k, 0) ELSE 0 END', 4)} AS yhat
        FROM (SELECT w.*, s.protocol, s.fold FROM whole_h w JOIN splits_h s ON s.series_id = w.series_id AND s.day = w.day AND s.role = 'test') t
        LEFT JOIN ({_HOURFIT}) f ON f.series_id = t.series_id AND f.protocol = t.protocol AND f.fold = t.fold AND f.h = hour(t.ts)"""
    ),
)
def m06_per_hour_ridge(spark, sf):
    rows = stored_rows(spark, sf, H)
    names = ["n_events", "mean_k"]
    fit = linear.ridge(rows, names, by={"h": F.hour("ts")})
    test = splits.eval_rows(rows).where(F.col("role") == "test").withColumn("h", F.hour("ts"))
    value = F.when(F.col("n_train") >= 12, linear.linear_value(names)).otherwise(0.0)
    out = test.join(fit, [*_F, "h"], "left").withColumn("yhat", F.coalesce(value, F.lit(0.0)))
    return tidy(out.select("protocol", "fold", "series_id", "slot", "yhat"), 4)


_BOOST_NAMES = [*H.setup.features, *backtest.CYCLES]


def _boosted_scores(spark, sf, member):
    fc = stored_boosted(spark, sf, H).where("role = 'test'").select(*_F, "slot", F.col(member).alias("yhat"))
    rows = stored_forecasts(spark, sf, H).where("role = 'test'").select(*_F, "slot", "y", "active", "is_missing", "capacity").join(fc, [*_F, "slot"])
    return tidy(M.with_subsets(M.observed(rows)).groupBy("series_id", "protocol", "fold", "subset").agg(*M.metric_columns(capacity=F.col("capacity"))))


@query("m04_boosting")
def m04_boosting(spark, sf):
    """Boosted trees of each series and fold, up to 800 rounds of depth 8, stopped early."""
    return _boosted_scores(spark, sf, "GBM")


@query("m05_ratio_boosting")
def m05_ratio_boosting(spark, sf):
    """The same on the bounded ratio to the clear-sky envelope, scaled back."""
    return _boosted_scores(spark, sf, "GBM_kt")


@query("m06_per_hour_boosting")
def m06_per_hour_boosting(spark, sf):
    """A model for each hour with at least 30 training rows; 0 in the other hours."""
    return _boosted_scores(spark, sf, "GBM_per_hour")


_HOURS = "SELECT series_id, protocol, fold, hour(ts) AS h, count(*) AS n FROM train_h GROUP BY ALL"


@query(
    "m04_boosted_rows",
    sql(
        f"""SELECT e.series_id, e.protocol, e.fold, e.role, count(*) AS n_rows, count(*) AS n_forecast, count(*) FILTER (WHERE e.driver < 50) AS n_low_driver,
        count(*) FILTER (WHERE e.driver < 50 AND u.n > 200) AS n_low_zero,
        count(*) FILTER (WHERE coalesce(t.n, 0) < 30) AS n_thin_hour, count(*) FILTER (WHERE coalesce(t.n, 0) < 30) AS n_thin_zero
        FROM fc_h e LEFT JOIN (SELECT series_id, protocol, fold, count(*) FILTER (WHERE driver > 50) AS n FROM train_h GROUP BY ALL) u
        ON u.series_id = e.series_id AND u.protocol = e.protocol AND u.fold = e.fold
        LEFT JOIN ({_HOURS}) t ON t.series_id = e.series_id AND t.protocol = e.protocol AND t.fold = e.fold AND t.h = hour(e.ts) GROUP BY ALL"""
    ),
)
def m04_boosted_rows(spark, sf):
    """Rows in and out of each fold's boosted models, and the rows that their rules set to 0."""
    rows = stored_forecasts(spark, sf, H).select(*_F, "role", "slot", "ts", "driver")
    train = splits.train_rows(stored_rows(spark, sf, H).drop("prev_pair"))
    usable = train.groupBy(*_F).agg(F.count_if(F.col("driver") > 50).alias("n_usable"))
    hours = train.groupBy(*_F, F.hour("ts").alias("h")).agg(F.count("*").alias("n_hour"))
    out = rows.join(stored_boosted(spark, sf, H), [*_F, "role", "slot"], "left").join(usable, _F, "left")
    out = out.withColumn("h", F.hour("ts")).join(hours, [*_F, "h"], "left")
    low, thin = F.col("driver") < 50, F.coalesce("n_hour", F.lit(0)) < 30
    known = F.col("GBM").isNotNull() & F.col("GBM_kt").isNotNull() & F.col("GBM_per_hour").isNotNull()
    return out.groupBy(*_F, "role").agg(
        F.count("*").alias("n_rows"), F.count_if(known).alias("n_forecast"), F.count_if(low).alias("n_low_driver"),
        F.count_if(low & (F.col("n_usable") > 200) & (F.col("GBM_kt") == 0)).alias("n_low_zero"),
        F.count_if(thin).alias("n_thin_hour"), F.count_if(thin & (F.col("GBM_per_hour") == 0)).alias("n_thin_zero"),
    )


@query("m07_permutation_importance")
def m07_permutation_importance(spark, sf):
    """Three deals of each feature over the active test rows of every series and fold."""
    rows = add_cyclic(stored_rows(spark, sf, H))
    caps = splits.fold_capacity(rows, rows.groupBy("series_id").agg(F.max("capacity").alias("capacity")))
    return tidy(fold_models.importance(rows, caps, _BOOST_NAMES))


def _variant_scores(variants: dict[str, tuple[str, str]], train: str = "train_h", whole: str = "whole_h", splits_: str = "splits_h") -> str:
    parts = []
    for name, (x1, x2) in variants.items():
        fit = ridge2(f"(SELECT *, {x1} AS a_, {x2} AS b_ FROM {train})", "a_", "b_", _FOLD)
        parts.append(
            f"""SELECT series_id, protocol, '{name}' AS config, subset, {metric_sql(cap='capacity')} FROM (
            SELECT t.*, greatest(w0 + w1*({x1}) + w2*({x2}), 0) AS yhat, unnest(CASE WHEN active THEN ['ALL', 'active'] ELSE ['ALL'] END) AS subset
            FROM (SELECT w.*, s.protocol, s.fold FROM {whole} w JOIN {splits_} s ON s.series_id = w.series_id AND s.day = w.day AND s.role = 'test' WHERE NOT is_missing) t
            JOIN ({fit}) f ON f.series_id = t.series_id AND f.protocol = t.protocol AND f.fold = t.fold) GROUP BY series_id, protocol, subset"""
        )
    return " UNION ALL ".join(parts)


_CAL = ("sin(2*pi()*hour(ts)/24)", "cos(2*pi()*hour(ts)/24)")


@query("m08_calendar_or_drivers", sql(_variant_scores({"calendar": _CAL, "drivers": ("n_events", "mean_k")})))
def m08_calendar_or_drivers(spark, sf):
    variants = {"calendar": ["hour_sin", "hour_cos"], "drivers": ["n_events", "mean_k"]}
    return tidy(grids.feature_ablation(stored_rows(spark, sf, H), variants))


_CONFIGS = {
    "analysis_full": Configuration("now", ("n_events", "mean_k")),
    "analysis_matched": Configuration("now", ("n_events",)),
    "day_ahead": Configuration("late", ("n_events",)),
    "reanalysis_full": Configuration("other", ("n_events", "mean_k")),
}
_PAIRS = [
    ("day_ahead_penalty", "analysis_matched", "day_ahead"),
    ("product_sensitivity", "analysis_full", "reanalysis_full"),
    ("dropped_variables", "analysis_full", "analysis_matched"),
]


def _product_rows(spark, sf, variables=("n_events", "mean_k")):
    """Rows with the variables of three products: as they are, a day late, and an hour late."""
    exog = stored_drivers(spark, sf, "h")
    tables_ = {"now": exog, "late": grid.relabel(exog, 24), "other": grid.relabel(exog, 1)}
    return with_products(stored_rows(spark, sf, H), tables.panel_h(spark, sf, bounds=True), tables_, variables)


def _configurations(spark, sf):
    rows = lambda: stage(_product_rows(spark, sf), "product-rows")
    return stored_as(spark, sf, "configurations", lambda: grids.variant_forecasts(rows(), variants(_CONFIGS)).drop("prev_pair"))


_NOW, _OTHER = ("n_events", "mean_k"), ("n_events_other", "mean_k_other")
_CONFIG_FITS = {
    "analysis_full": (ridge2("train_q", *_NOW, _FOLD), f"w0 + w1*{_NOW[0]} + w2*{_NOW[1]}"),
    "analysis_matched": (ridge1("train_q", "n_events", _FOLD), "w0 + w1*n_events"),
    "day_ahead": (ridge1("train_q", "n_events_late", _FOLD), "w0 + w1*n_events_late"),
    "reanalysis_full": (ridge2("train_q", *_OTHER, _FOLD), f"w0 + w1*{_OTHER[0]} + w2*{_OTHER[1]}"),
}
_CONFIG_ROWS = " UNION ALL ".join(
    f"""SELECT t.series_id, t.protocol, t.slot, t.y, t.capacity, t.active, '{name}' AS config, greatest({value}, 0) AS yhat
    FROM test_q t JOIN prod_h p ON p.series_id = t.series_id AND p.slot = t.slot JOIN ({fit}) f ON f.series_id = t.series_id AND f.protocol = t.protocol AND f.fold = t.fold WHERE NOT t.is_missing"""
    for name, (fit, value) in _CONFIG_FITS.items()
)


@query(
    "g02_configurations",
    sql(
        f"""SELECT series_id, protocol, config, subset, {metric_sql(cap='capacity')} FROM (SELECT *, unnest(CASE WHEN active THEN ['ALL', 'active'] ELSE ['ALL'] END) AS subset FROM ({_CONFIG_ROWS}))
        GROUP BY ALL"""
    ),
)
def g02_configurations(spark, sf):
    """Four configurations of three products and two variable sets, fitted in one pass."""
    long = M.to_long(_configurations(spark, sf), list(_CONFIGS)).withColumnRenamed("model", "config")
    rows = M.with_subsets(M.observed(long))
    return tidy(rows.groupBy("series_id", "protocol", "config", "subset").agg(*M.metric_columns(capacity=F.col("capacity"))))


@query(
    "x20_priced_configurations",
    sql(
        f"""SELECT * FROM (WITH c AS MATERIALIZED ({_CONFIG_ROWS}) SELECT n.comparison, v.series_id, v.protocol, count(*) AS n_common, {r('sqrt(avg((v.y - b.yhat)**2))', 4)} AS reference_rmse, {r('sqrt(avg((v.y - v.yhat)**2))', 4)} AS variant_rmse,
        {r('100 * (sqrt(avg((v.y - v.yhat)**2)) - sqrt(avg((v.y - b.yhat)**2))) / max(v.capacity)', 4)} AS nrmse_change_pp,
        {r('100 * (sqrt(avg((v.y - v.yhat)**2)) / sqrt(avg((v.y - b.yhat)**2)) - 1)', 4)} AS relative_rmse_change_pct,
        {r('avg((v.y - v.yhat)**2 - (v.y - b.yhat)**2) / sqrt(var_samp((v.y - v.yhat)**2 - (v.y - b.yhat)**2) / count(*))', 4)} AS statistic
        FROM (VALUES {', '.join(str(x) for x in _PAIRS)}) n(comparison, a, z) JOIN c b ON b.config = n.a JOIN c v ON v.config = n.z AND v.series_id = b.series_id AND v.protocol = b.protocol AND v.slot = b.slot
        WHERE v.active GROUP BY n.comparison, v.series_id, v.protocol)"""
    ),
)
def x20_priced_configurations(spark, sf):
    """What a day-ahead product, another product and fewer variables cost."""
    return tidy(grids.price_columns(_configurations(spark, sf), _PAIRS).drop("p_value", "better"), 4)


@query("x20_verdicts")
def x20_verdicts(spark, sf):
    """The same pairs with their p-values and verdicts."""
    return tidy(grids.price_columns(_configurations(spark, sf), _PAIRS).select("comparison", "series_id", "protocol", "n_common", "statistic", "p_value", "better"))


@query("g01_feature_ablation")
def g01_feature_ablation(spark, sf):
    """Ridge on all features, without alignment of the drivers, without the solar features, and
    without temporal context: one moment matrix, a block for each."""
    variables = ("n_events", "mean_value", "mean_k")
    rows = _product_rows(spark, sf, variables).withColumns({"_lat": F.lit(LAT), "_lon": F.lit(LON)})
    rows = sun_position(rows.drop("sun_elev"), "_lat", "_lon").drop("_lat", "_lon", "sun_az")
    late = [of_product(v, "other") for v in variables]
    rows = stage(temporal_context(rows, [late[0], late[1]]), "ablation")
    solar, context, cycle = ["sun_elev", "cos_zenith"], _context(stored_rows(spark, sf, H)), ["doy_sin", "doy_cos"]
    full = [*variables, *solar, *context, *cycle]
    unaligned = [*late, *solar, *[c for c in _context(rows) if "__other" in c], *cycle]
    without = {name: ablate(rows, full, [group])[1] for name, group in (("calendar_only", "solar"), ("no_temporal", "context"))}
    return tidy(grids.feature_ablation(rows, {"full": full, "no_alignment": unaligned, **without}))


_PRICE = f"""SELECT 'late_penalty' AS comparison, v.series_id, v.protocol, count(*) AS n_common, {r('sqrt(avg((v.y - b.OLS2)**2))', 4)} AS reference_rmse, {r('sqrt(avg((v.y - v.OLS2)**2))', 4)} AS variant_rmse,
    {r('100 * (sqrt(avg((v.y - v.OLS2)**2)) - sqrt(avg((v.y - b.OLS2)**2))) / max(v.capacity)', 4)} AS nrmse_change_pp,
    {r('100 * (sqrt(avg((v.y - v.OLS2)**2)) / sqrt(avg((v.y - b.OLS2)**2)) - 1)', 4)} AS relative_rmse_change_pct,
    {r('avg((v.y - v.OLS2)**2 - (v.y - b.OLS2)**2) / sqrt(var_samp((v.y - v.OLS2)**2 - (v.y - b.OLS2)**2) / count(*))', 4)} AS statistic
    FROM (SELECT *, split_part(series_id, '/', 1) AS config, split_part(series_id, '/', 2) AS sid FROM test_p WHERE active AND NOT is_missing) v
    JOIN (SELECT *, split_part(series_id, '/', 1) AS config, split_part(series_id, '/', 2) AS sid FROM test_p WHERE active AND NOT is_missing) b ON b.sid = v.sid AND b.protocol = v.protocol AND b.slot = v.slot
    WHERE v.config = 'late' AND b.config = 'now' GROUP BY v.sid, v.protocol"""


def _products(spark, sf):
    exog = stored_drivers(spark, sf, "h")
    panel = tables.panel_h(spark, sf, bounds=True)
    frames = {"now": hourly_frame(panel, exog), "late": hourly_frame(panel, grid.relabel(exog, 24)), "other": hourly_frame(panel, grid.relabel(exog, 1))}
    return stored_as(spark, sf, "product-forecasts", lambda: grids.compare_products(frames, H.setup, MODELS))


@query(
    "g02_product_scores",
    sql(f"SELECT split_part(series_id, '/', 1) AS config, split_part(series_id, '/', 2) AS series_id, protocol, model, subset, {metric_sql(cap='capacity', digits=5)} FROM sub_p GROUP BY ALL"),
)
def g02_product_scores(spark, sf):
    keys = ["config", "series_id", "protocol", "model", "subset"]
    return tidy(M.score(M.with_subsets(_products(spark, sf)), keys, F.col("capacity")), 5)


_PRODUCT_OF = {"analysis_full": "now", "analysis_matched": "now", "day_ahead": "late", "reanalysis_full": "other"}


@query(
    "x19_degradation_pivot",
    sql(
        "SELECT series_id, protocol, model, "
        + ", ".join(f"{r(f'max(nrmse) FILTER (WHERE product = $${p}$$)', 3)} AS {c}" for c, p in _PRODUCT_OF.items())
        + """ FROM (SELECT split_part(series_id, '/', 1) AS product, split_part(series_id, '/', 2) AS series_id, protocol, model, 100 * sqrt(avg((y - yhat)**2)) / max(capacity) AS nrmse
        FROM sub_p WHERE subset = 'active' AND model IN ('Persistence', 'Climatology', 'SmartPersistence') GROUP BY ALL) GROUP BY ALL"""
    ),
)
def x19_degradation_pivot(spark, sf):
    """How much each reference forecast degrades with the driver product: a column a configuration."""
    rows = M.with_subsets(_products(spark, sf)).where("subset = 'active'").where(F.col("model").isin(MODELS[:3]))
    scores = M.score(rows, ["config", "series_id", "protocol", "model"], F.col("capacity"))
    of = F.array(*[F.struct(F.lit(c).alias("configuration"), F.lit(p).alias("config")) for c, p in _PRODUCT_OF.items()])
    named = scores.select("*", F.explode(of).alias("_c")).where("_c.config = config").withColumn("configuration", F.col("_c.configuration"))
    return tidy(M.pivot_scores(named, ["series_id", "protocol", "model"], "configuration", "nrmse_pct", list(_PRODUCT_OF)), 3)


@query("x20_priced_pairs", sql(_PRICE.replace("v.series_id, v.protocol, count", "v.sid AS series_id, v.protocol, count")))
def x20_priced_pairs(spark, sf):
    out = grids.price_pairs(_products(spark, sf), [("late_penalty", "now", "late")], "OLS2")
    return tidy(out.drop("p_value", "better"), 4)


_BOUNDED = f"""SELECT t.series_id, t.protocol, t.fold, t.active, t.y, t.capacity, b.bound,
    greatest(coalesce(CASE WHEN w.pair_y IS NOT NULL THEN least(greatest(w.pair_y / greatest(t.capacity_fold*w.pair_g/1000.0, 1.0), 0.0), b.bound) END, rs.v, ra.v, 0) * greatest(t.capacity_fold*coalesce(w.driver, 0)/1000.0, 0), 0) AS yhat
    FROM test_h t JOIN whole_h w ON w.series_id = t.series_id AND w.slot = t.slot, (SELECT unnest([1.0, 1.25, 1.5, 2.0, 3.0, 'Infinity'::DOUBLE]) AS bound) b
    LEFT JOIN (SELECT series_id, protocol, fold, s, bound, avg(least(greatest(y / greatest(capacity_fold*driver/1000.0, 1.0), 0.0), bound)) AS v
      FROM (SELECT *, slot % 24 AS s FROM train_h JOIN fcap_h USING (series_id, protocol, fold)), (SELECT unnest([1.0, 1.25, 1.5, 2.0, 3.0, 'Infinity'::DOUBLE]) AS bound) GROUP BY ALL) rs
    ON rs.series_id = t.series_id AND rs.protocol = t.protocol AND rs.fold = t.fold AND rs.s = t.slot % 24 AND rs.bound = b.bound
    LEFT JOIN (SELECT series_id, protocol, fold, bound, avg(least(greatest(y / greatest(capacity_fold*driver/1000.0, 1.0), 0.0), bound)) AS v
      FROM (SELECT * FROM train_h JOIN fcap_h USING (series_id, protocol, fold)), (SELECT unnest([1.0, 1.25, 1.5, 2.0, 3.0, 'Infinity'::DOUBLE]) AS bound) GROUP BY ALL) ra
    ON ra.series_id = t.series_id AND ra.protocol = t.protocol AND ra.fold = t.fold AND ra.bound = b.bound WHERE NOT t.is_missing"""


@query(
    "g03_bound_sweep",
    sql(
        f"""SELECT series_id, protocol, subset, CAST(bound AS VARCHAR) AS bound, n, {r('rmse')} AS rmse, {r('nrmse')} AS nrmse_pct, {r('max(nrmse) OVER w - min(nrmse) OVER w')} AS spread,
        {r('nrmse - max(nrmse) FILTER (WHERE bound = 1.5) OVER w')} AS change FROM (SELECT series_id, protocol, subset, bound, count(*) AS n, sqrt(avg((y - yhat)**2)) AS rmse, sqrt(avg((y - yhat)**2))/max(capacity)*100 AS nrmse
        FROM (SELECT *, unnest(CASE WHEN active THEN ['ALL', 'active'] ELSE ['ALL'] END) AS subset FROM ({_BOUNDED})) GROUP BY ALL) WINDOW w AS (PARTITION BY series_id, protocol, subset)"""
    ),
)
def g03_bound_sweep(spark, sf):
    out = grids.bound_sweep(stored_frame(spark, sf, H), H.setup, [1.0, 1.25, 1.5, 2.0, 3.0, float("inf")], 1.5)
    label = F.when(F.col("bound") == float("inf"), "inf").otherwise(F.col("bound").cast("string"))
    return tidy(out.withColumn("bound", label))


@query(
    "g04_shift_sensitivity",
    sql(
        f"""SELECT split_part(series_id, '/', 1) AS shift, split_part(series_id, '/', 2) AS series_id, protocol, model, subset, {metric_sql(cap='capacity', digits=5)} FROM sub_w GROUP BY ALL"""
    ),
)
def g04_shift_sensitivity(spark, sf):
    panels = grids.shifted_frames(stage(tables.panel_h(spark, sf, bounds=True), "panel"), HOURLY, [0, -1, -2])
    exog = stored_drivers(spark, sf, "h")
    frames = {k: hourly_frame(p, exog) for k, p in panels.items()}
    pred = grids.compare_products(frames, H.setup, MODELS).withColumnRenamed("config", "shift")
    keys = ["shift", "series_id", "protocol", "model", "subset"]
    return tidy(M.score(M.with_subsets(pred), keys, F.col("capacity")), 5)


_SEEDS = "SELECT split_part(series_id, '/', 1) AS seed, split_part(series_id, '/', 2) AS series_id, protocol, model, subset, 1 - sum((y - yhat)**2)/(var_pop(y)*count(*)) AS r2, avg(abs(y - yhat)) AS mae, sqrt(avg((y - yhat)**2)) AS rmse FROM sub_r WHERE protocol = 'random_day' GROUP BY ALL"


@query(
    "g05_seed_repetition",
    sql(
        "SELECT series_id, protocol, model, subset, "
        + ", ".join(f"{r(f'avg({c})', 5)} AS {c}_mean, {r(f'stddev_samp({c})', 5)} AS {c}_sd" for c in ("r2", "mae", "rmse"))
        + f", count(DISTINCT seed) AS n_runs, {r('1 - avg(rmse) / max(avg(rmse)) FILTER (WHERE model = $$SmartPersistence$$) OVER (PARTITION BY series_id, protocol, subset)', 5)} AS skill FROM ({_SEEDS}) GROUP BY series_id, protocol, model, subset"
    ),
)
def g05_seed_repetition(spark, sf):
    frame = stored_frame(spark, sf, H)
    return tidy(grids.seed_repetition(frame, H.setup, [0, 1, 2, 3, 4], MODELS), 5)


def _ctx_fit(x1: str, x2: str) -> str:
    return ridge2("(SELECT t.*, c.roll3 FROM train_w t JOIN ctx_w c ON c.series_id = t.series_id AND c.slot = t.slot)", x1, x2, _FOLD)


_CTX = f"""SELECT t.series_id, t.protocol, sqrt(avg((t.y - greatest(a.w0 + a.w1*t.n_events + a.w2*t.roll3, 0))**2)) AS ctx,
    sqrt(avg((t.y - greatest(b.w0 + b.w1*t.n_events + b.w2*t.mean_value, 0))**2)) AS plain
    FROM (SELECT w.*, s.protocol, s.fold, c.roll3 FROM whole_w w JOIN splits_w s ON s.series_id = w.series_id AND s.day = w.day AND s.role = 'test'
      JOIN ctx_w c ON c.series_id = w.series_id AND c.slot = w.slot WHERE active AND NOT is_missing) t
    JOIN ({_ctx_fit('n_events', 'roll3')}) a ON a.series_id = t.series_id AND a.protocol = t.protocol AND a.fold = t.fold
    JOIN ({_ctx_fit('n_events', 'mean_value')}) b ON b.series_id = t.series_id AND b.protocol = t.protocol AND b.fold = t.fold GROUP BY ALL"""


@query(
    "g06_alignment_by_context",
    sql(
        f"""SELECT split_part(x.series_id, '/', 2) AS series_id, x.protocol, {r('x.ctx - y.ctx', 5)} AS effect_with, {r('x.plain - y.plain', 5)} AS effect_without,
        {r('x.ctx - y.ctx - x.plain + y.plain', 5)} AS interaction FROM ({_CTX}) x JOIN ({_CTX}) y ON split_part(y.series_id, '/', 2) = split_part(x.series_id, '/', 2) AND y.protocol = x.protocol
        WHERE split_part(x.series_id, '/', 1) = '0' AND split_part(y.series_id, '/', 1) = '-1'"""
    ),
)
def g06_alignment_by_context(spark, sf):
    """Does alignment matter more with or without temporal context?"""
    panels = grids.shifted_frames(stage(tables.panel_h(spark, sf, bounds=True), "panel"), HOURLY, [0, -1])
    exog = stored_drivers(spark, sf, "h")
    frame = grids.stack_frames({k: hourly_frame(p, exog) for k, p in panels.items()})
    frame = stage(temporal_context(frame, ["n_events"]), "frame")
    rows = stage(backtest.scored_frame(frame, H.setup)[0], "rows")
    variants = {"context": ["n_events", "n_events_roll3"], "plain": ["n_events", "mean_value"]}
    scores = grids.split_key(grids.feature_ablation(rows, variants).withColumnRenamed("config", "features"), "shift")
    flags = scores.withColumns({"aligned": F.col("shift") == "0", "context": F.col("features") == "context"})
    return tidy(M.two_by_two(flags.where(F.col("subset") == "active"), ["series_id", "protocol"], "aligned", "context", "rmse"), 5)


_ARMS = {
    "left_out": "train_h",
    "as_zero": "(SELECT w.* EXCLUDE (y), w.y_filled AS y, s.protocol, s.fold FROM whole_h w JOIN splits_h s ON s.series_id = w.series_id AND s.day = w.day AND s.role = 'train')",
    "weighted": "(SELECT *, unnest(CASE WHEN active THEN [1, 2, 3, 4] ELSE [1] END) FROM train_h)",
}
_ARM_ROWS = "SELECT t.series_id, t.protocol, t.y, " + ", ".join(
    f"greatest({a}.w0 + {a}.w1*t.n_events + {a}.w2*t.mean_value, 0) AS {a}" for a in _ARMS
) + " FROM (SELECT w.*, s.protocol, s.fold FROM whole_h w JOIN splits_h s ON s.series_id = w.series_id AND s.day = w.day AND s.role = 'test' WHERE active AND NOT is_missing) t " + " ".join(
    f"JOIN ({ridge2(src, 'n_events', 'mean_value', _FOLD)}) {a} ON {a}.series_id = t.series_id AND {a}.protocol = t.protocol AND {a}.fold = t.fold" for a, src in _ARMS.items()
)


@query(
    "g07_missing_arms",
    sql(
        " UNION ALL ".join(
            f"""SELECT series_id, protocol, '{a}' AS arm, count(*) AS n, {r(f'sqrt(avg((y - {a})**2))', 4)} AS rmse, {r(f'avg((y - {a})**2 - (y - as_zero)**2)', 3)} AS mean_diff,
            {r(f'avg((y - {a})**2 - (y - as_zero)**2) / sqrt(var_samp((y - {a})**2 - (y - as_zero)**2) / count(*))', 4)} AS statistic FROM ({_ARM_ROWS}) GROUP BY series_id, protocol"""
            for a in ("left_out", "weighted")
        )
    ),
)
def g07_missing_arms(spark, sf):
    out = grids.missing_arms(stored_rows(spark, sf, H), ["n_events", "mean_value"])
    return tidy(out.select("series_id", "protocol", "arm", "n", "rmse", "mean_diff", "statistic"), 4, mean_diff=3)


@query("g07_mask_arms")
def g07_mask_arms(spark, sf):
    """The mask as features, as loss weights, as both and as neither, on day windows of every fold."""
    frame = stored_frame(spark, sf, H)
    folds = backtest.scored_frame(frame, H.setup)[1]
    rows, plain, seen = masks.hour_rows(grid.complete_days(frame), folds, ["driver"])
    forecasts = masks.arm_forecasts(stage(rows, "windows"), plain, seen)
    return tidy(masks.score_arms(stage(forecasts, "arms")), 5)


_ALL = [*MODELS, *fusion.VARIANTS]


@query(
    "g08_headline",
    sql(
        f"""SELECT * EXCLUDE (ref), {r('1 - rmse_ / ref')} AS skill FROM (SELECT * , max(rmse_) FILTER (WHERE model = 'SmartPersistence') OVER (PARTITION BY series_id, protocol, subset) AS ref FROM (
        SELECT series_id, protocol, model, subset, {metric_sql(cap='capacity', digits=4)}, sqrt(avg((y - yhat)**2)) AS rmse_ FROM (SELECT series_id, protocol, y, capacity, unnest(CASE WHEN active THEN ['ALL', 'active'] ELSE ['ALL'] END) AS subset, model, yhat
        FROM (SELECT series_id, protocol, y, capacity, active, unnest([{', '.join(f"'{m}'" for m in _ALL)}]) AS model, unnest([{', '.join(_ALL)}]) AS yhat FROM fused_h WHERE NOT is_missing)) GROUP BY ALL))"""
    ).replace("EXCLUDE (ref)", "EXCLUDE (ref, rmse_)"),
)
def g08_headline(spark, sf):
    """The backtest's metric table, from stored forecasts and their fusions."""
    return tidy(backtest.score_all(stored_fused(spark, sf, H), _ALL), 4, skill=6)


@query("g08_headline_six_members")
def g08_headline_six_members(spark, sf):
    """References, linear and boosted members and their fusions."""
    return tidy(backtest.score_all(stored_all_fused(spark, sf, H), [*backtest.REFERENCES, *backtest.BASES, *backtest.BOOSTED, *fusion.VARIANTS]), 4, skill=6)


@query("g08_headline_from_log")
def g08_headline_from_log(spark, sf):
    """The same job from the event log onwards, with all members, nothing stored before."""
    return tidy(backtest.headline(H.frame(spark, sf), H.setup))
