"""Splits, reference forecasts and the joins they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import DAILY, HOURLY, season_slot
from ..operators import grid, joins, reference, splits
from ..operators.grid import complete_days, day_facts
from ..operators.metrics import metric_columns, observed
from ..plans.backtest import scored_frame
from ..plans.datasets import D, E, H, stored_forecasts, stored_frame
from ..sources import tables
from .features import ENVELOPE_SQL
from .registry import query, tidy
from .sql import metric_sql, r, sql

_BACK = "(PARTITION BY series_id, slot % 24 ORDER BY slot // 24 RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)"


@query(
    "a_persistence_score",
    sql(
        f"""SELECT series_id, {metric_sql(cap='capacity')} FROM (SELECT p.*, capacity,
        last_value(y IGNORE NULLS) OVER (PARTITION BY p.series_id, slot % 24 ORDER BY slot // 24 RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING) AS yhat
        FROM panel_u p JOIN (SELECT series_id, quantile_cont(y_filled, 0.999) AS capacity FROM panel_u GROUP BY 1) c ON c.series_id = p.series_id)
        WHERE NOT is_missing GROUP BY 1"""
    ),
)
def a_persistence_score(spark, sf):
    """Day-ahead persistence of every user series: log to score in one plan."""
    panel = tables.panel_u(spark, sf)
    back = joins.lookback(panel, {"yhat": F.col("y")}, HOURLY)
    rows = grid.attach(observed(back), grid.capacity(panel), ["series_id"])
    return tidy(rows.groupBy("series_id").agg(*metric_columns(capacity=F.col("capacity"))))


@query("j04_lookback", sql(f"SELECT series_id, slot, last_value(y IGNORE NULLS) OVER {_BACK} AS prev_y FROM panel_h"))
def j04_lookback(spark, sf):
    out = joins.lookback(tables.panel_h(spark, sf), {"prev_y": F.col("y")}, HOURLY)
    return out.select("series_id", "slot", "prev_y")


@query(
    "j04_lookback_zero_filled",
    sql(f"SELECT series_id, slot, last_value(y_filled IGNORE NULLS) OVER {_BACK} AS prev_y FROM panel_h"),
)
def j04_lookback_zero_filled(spark, sf):
    out = reference.with_lookback(tables.panel_h(spark, sf), HOURLY, missing="zero")
    return out.select("series_id", "slot", "prev_y")


def _test(spark, sf, ds):
    return stored_forecasts(spark, sf, ds).where(F.col("role") == "test")


@query(
    "j05_fallback_lookup",
    sql(f"SELECT protocol, fold, series_id, ts, {r('Climatology', 4)} AS clim FROM test_e"),
)
def j05_fallback_lookup(spark, sf):
    return tidy(_test(spark, sf, E).select("protocol", "fold", "series_id", "ts", F.col("Climatology").alias("clim")), 4)


@query(
    "j06_observed_lag",
    sql("SELECT series_id, slot FROM panel_h p WHERE NOT is_missing AND EXISTS (SELECT 1 FROM panel_h q WHERE q.series_id = p.series_id AND q.slot = p.slot - 24 AND NOT q.is_missing)"),
)
def j06_observed_lag(spark, sf):
    panel = tables.panel_h(spark, sf)
    return joins.observed_before(panel.select("series_id", "slot", "is_missing"), 24).where("not is_missing").select("series_id", "slot")


_SEEN = "SELECT DISTINCT series_id, protocol, fold, month(ts) AS m, slot % 7 AS s FROM train_e"


@query(
    "j07_unseen_cells",
    sql(
        f"""SELECT t.series_id, t.protocol, t.fold, t.slot FROM test_e t WHERE NOT is_missing AND NOT EXISTS (SELECT 1 FROM ({_SEEN}) c
        WHERE c.series_id = t.series_id AND c.protocol = t.protocol AND c.fold = t.fold AND c.m = month(t.ts) AND c.s = t.slot % 7)"""
    ),
)
def j07_unseen_cells(spark, sf):
    assigned, _ = scored_frame(stored_frame(spark, sf, E), E.setup)
    cell = {"m": F.month("ts"), "s": season_slot(F.col("slot"), DAILY)}
    seen = splits.fold_sums(assigned, {"n": F.lit(1)}, cell)
    scored = observed(splits.eval_rows(assigned)).where(F.col("role") == "test").withColumns(cell)
    keys = ["series_id", "protocol", "fold", "m", "s"]
    return joins.unseen_cells(scored, seen, keys).select("series_id", "protocol", "fold", "slot")


@query(
    "j12_attach_constants",
    sql(f"SELECT protocol, fold, series_id, role, count(*) AS n, {r('max(capacity_fold)', 4)} AS capacity_fold, {r('max(capacity)', 4)} AS capacity FROM fc_d GROUP BY ALL"),
)
def j12_attach_constants(spark, sf):
    return tidy(
        stored_forecasts(spark, sf, D)
        .groupBy("protocol", "fold", "series_id", "role")
        .agg(F.count("*").alias("n"), F.max("capacity_fold").alias("capacity_fold"), F.max("capacity").alias("capacity")),
        4,
    )


_SPLIT = "SELECT series_id, protocol, fold, CAST(day AS VARCHAR) AS day, role FROM splits_{x} WHERE protocol = '{p}'"


def _days(spark, sf, ds):
    return day_facts(complete_days(ds.panel(spark, sf), ds.setup.slots_per_day))


@query("p01_rolling_origin", sql(_SPLIT.format(x="d", p="rolling_origin")))
def p01_rolling_origin(spark, sf):
    return tidy(splits.rolling_origin(_days(spark, sf, D), **D.setup.rolling))


@query("p02_random_days", sql(_SPLIT.format(x="d", p="random_day")))
def p02_random_days(spark, sf):
    return tidy(splits.random_days(_days(spark, sf, D), **D.setup.random))


@query("p03_validation_tail", sql("SELECT series_id, fold, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS n_days FROM splits_h WHERE protocol = 'rolling_origin' AND role = 'val' GROUP BY ALL"))
def p03_validation_tail(spark, sf):
    val = splits.rolling_origin(_days(spark, sf, H), **H.setup.rolling).where(F.col("role") == "val")
    return tidy(
        val.groupBy("series_id", "fold").agg(
            F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("n_days")
        )
    )


@query("p04_random_validation", sql("SELECT series_id, fold, CAST(day AS VARCHAR) AS day FROM splits_h WHERE protocol = 'random_day' AND role = 'val'"))
def p04_random_validation(spark, sf):
    val = splits.random_days(_days(spark, sf, H), **H.setup.random).where(F.col("role") == "val")
    return tidy(val.select("series_id", "fold", "day"))


@query("p05_fold_capacity", sql(f"SELECT series_id, protocol, fold, n_train, {r('capacity_fold', 4)} AS capacity FROM fcap_h"))
def p05_fold_capacity(spark, sf):
    rows = complete_days(tables.panel_h(spark, sf))
    folds = splits.both_protocols(day_facts(rows), H.setup.rolling, H.setup.random)
    return tidy(splits.fold_capacity(splits.assign(rows, folds), grid.capacity(tables.panel_h(spark, sf))), 4)


@query(
    "p06_older_splits",
    sql(
        """SELECT 'tail_share' AS kind, series_id, CASE WHEN i > n - greatest(168, floor(n * 0.15)) THEN 'val' ELSE 'train' END AS role, count(*) AS n
        FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY slot) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM panel_u WHERE NOT is_missing) GROUP BY ALL
        UNION ALL SELECT 'head_share', series_id, CASE WHEN i <= floor(n * 0.7) THEN 'train' ELSE 'test' END, count(*)
        FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY slot) AS i, count(*) OVER (PARTITION BY series_id) AS n FROM panel_u WHERE NOT is_missing) GROUP BY ALL
        UNION ALL SELECT 'tail_days', p.series_id, CASE WHEN ts < e - INTERVAL 9 DAY THEN 'train' ELSE 'test' END, count(*)
        FROM panel_u p JOIN (SELECT series_id, max(ts) AS e FROM panel_u WHERE NOT is_missing GROUP BY 1) x ON x.series_id = p.series_id WHERE NOT is_missing GROUP BY ALL
        UNION ALL SELECT 'head_days_share', p.series_id, CASE WHEN r <= floor(n * 0.8) THEN 'train' ELSE 'test' END, count(*) FROM (SELECT *, CAST(ts AS DATE) AS day FROM panel_u WHERE NOT is_missing) p
        JOIN (SELECT series_id, day, row_number() OVER (PARTITION BY series_id ORDER BY day) AS r, count(*) OVER (PARTITION BY series_id) AS n FROM (SELECT DISTINCT series_id, CAST(ts AS DATE) AS day FROM panel_u WHERE NOT is_missing)) d
        ON d.series_id = p.series_id AND d.day = p.day GROUP BY ALL
        UNION ALL SELECT 'random_rows', series_id, CASE WHEN CAST('0x' || substr(md5('0|' || series_id || '|' || slot), 1, 8) AS BIGINT) / 4294967296.0 < 0.1 THEN 'val' ELSE 'train' END, count(*)
        FROM panel_u WHERE NOT is_missing GROUP BY ALL"""
    ),
)
def p06_older_splits(spark, sf):
    rows = observed(tables.panel_u(spark, sf))
    kinds = {"tail_share": (0.15, 168), "head_share": (0.7, 0), "tail_days": (9, 0), "head_days_share": (0.8, 0), "random_rows": (0.1, 0)}
    out = None
    for kind, (value, low) in kinds.items():
        part = splits.time_split(rows, kind, value, low).groupBy("series_id", "role").agg(F.count("*").alias("n"))
        part = part.select(F.lit(kind).alias("kind"), "series_id", "role", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "p07_walk_forward",
    sql(
        """SELECT series_id, 'W' || (b + 1) AS fold, CAST(first + CAST(120 + b * 14 AS INT) AS VARCHAR) AS origin, CAST(day AS VARCHAR) AS day, n_obs, n_train FROM (
        SELECT *, min(before) OVER (PARTITION BY series_id, b) AS n_train FROM (SELECT *, (day - first - 120) // 14 AS b FROM (
        SELECT *, min(day) OVER (PARTITION BY series_id) AS first, coalesce(sum(n_obs) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM days_d)
        WHERE day - first >= 120)) WHERE n_train >= 1000"""
    ),
)
def p07_walk_forward(spark, sf):
    return tidy(splits.walk_forward(_days(spark, sf, D)))


@query(
    "p08_hidden_history",
    sql(
        f"""SELECT w.series_id, s.fold, count(*) AS n, count(*) FILTER (WHERE NOT w.is_missing AND s.role = 'train') AS n_usable,
        {r("sum(CASE WHEN s.role = 'train' THEN w.y_filled ELSE 0 END)", 4)} AS visible
        FROM whole_h w JOIN splits_h s ON s.series_id = w.series_id AND s.day = w.day WHERE s.protocol = 'random_day' GROUP BY ALL"""
    ),
)
def p08_hidden_history(spark, sf):
    rows = complete_days(tables.panel_h(spark, sf))
    folds = splits.random_days(day_facts(rows), **H.setup.random)
    out = splits.hide_history(rows, folds)
    return tidy(
        out.groupBy("series_id", "fold").agg(
            F.count("*").alias("n"),
            F.count_if("history_available").alias("n_usable"),
            F.sum("history_y").alias("visible"),
        ),
        4,
    )


def _fc(name: str, x: str) -> str:
    return sql(f"SELECT protocol, fold, role, series_id, ts, {r(name)} AS yhat FROM fc_{x}")


def _one(spark, sf, ds, name):
    return tidy(stored_forecasts(spark, sf, ds).select("protocol", "fold", "role", "series_id", "ts", F.col(name).alias("yhat")))


@query("b01_persistence", _fc("Persistence", "h"))
def b01_persistence(spark, sf):
    return _one(spark, sf, H, "Persistence")


@query("b02_climatology", _fc("Climatology", "h"))
def b02_climatology(spark, sf):
    return _one(spark, sf, H, "Climatology")


@query("b03_smart_persistence", _fc("SmartPersistence", "h"))
def b03_smart_persistence(spark, sf):
    return _one(spark, sf, H, "SmartPersistence")


@query(
    "b04_all_references",
    sql(f"SELECT protocol, fold, role, series_id, ts, {r('Persistence', 4)} AS persistence, {r('Climatology', 4)} AS climatology, {r('SmartPersistence', 4)} AS smart FROM fc_d"),
)
def b04_all_references(spark, sf):
    return tidy(
        stored_forecasts(spark, sf, D).select(
            "protocol", "fold", "role", "series_id", "ts",
            F.col("Persistence").alias("persistence"), F.col("Climatology").alias("climatology"), F.col("SmartPersistence").alias("smart"),
        ),
        4,
    )


@query(
    "b05_longer_persistence",
    sql("SELECT series_id, slot, lag(y, 48) OVER w AS persistence_48, lag(y, 168) OVER w AS persistence_168 FROM panel_h WINDOW w AS (PARTITION BY series_id ORDER BY slot)"),
)
def b05_longer_persistence(spark, sf):
    return reference.lag_forecasts(tables.panel_h(spark, sf), [48, 168]).select(
        "series_id", "slot", "persistence_48", "persistence_168"
    )


@query(
    "b06_in_sample_climatology",
    sql(f"SELECT series_id, slot, {r('avg(y_filled) OVER (PARTITION BY series_id, slot % 24)')} AS clim_slot, {r('avg(y_filled) OVER (PARTITION BY series_id, month(ts), slot % 24)')} AS clim_cell FROM panel_h"),
)
def b06_in_sample_climatology(spark, sf):
    out = reference.in_sample_climatology(tables.panel_h(spark, sf), HOURLY)
    return tidy(out.select("series_id", "slot", "clim_slot", "clim_cell"))


@query(
    "b07_year_climatology",
    sql(
        f"""SELECT p.series_id, p.slot, {r('c.v', 4)} AS clim FROM panel_d p JOIN (SELECT t.series_id, t.s, t.doy, avg(q.y) AS v
        FROM (SELECT DISTINCT series_id, slot % 7 AS s, dayofyear(ts) AS doy FROM panel_d) t JOIN panel_d q ON q.series_id = t.series_id AND q.slot % 7 = t.s AND NOT q.is_missing
        AND least((dayofyear(q.ts) - t.doy + 732) % 366, (t.doy - dayofyear(q.ts) + 732) % 366) <= 7 GROUP BY ALL) c
        ON c.series_id = p.series_id AND c.s = p.slot % 7 AND c.doy = dayofyear(p.ts)"""
    ),
)
def b07_year_climatology(spark, sf):
    panel = tables.panel_d(spark, sf)
    out = reference.at_year_cell(panel, reference.year_climatology(panel, DAILY), DAILY)
    return tidy(out.select("series_id", "slot", "clim"), 4)


@query(
    "b08_envelope_persistence",
    sql(
        f"""SELECT series_id, slot, {r('lag(CASE WHEN y IS NOT NULL THEN least(greatest(y/env, 0.0), 1.5) END, 7) OVER (PARTITION BY series_id ORDER BY slot) * env', 4)} AS yhat
        FROM (SELECT p.*, e.env FROM panel_d p JOIN ({ENVELOPE_SQL}) e ON e.series_id = p.series_id AND e.s = p.slot % 7 AND e.doy = dayofyear(p.ts))"""
    ),
)
def b08_envelope_persistence(spark, sf):
    out = reference.envelope_persistence(tables.panel_d(spark, sf), DAILY, lag=7)
    return tidy(out.select("series_id", "slot", "yhat"), 4)


@query("b09_physics_proxy", sql(f"SELECT series_id, slot, {r('capacity * driver / 1000.0')} AS yhat FROM frame_h"))
def b09_physics_proxy(spark, sf):
    frame = stored_frame(spark, sf, H)
    return tidy(frame.select("series_id", "slot", reference.physics_proxy(F.col("capacity"), F.col("driver")).alias("yhat")))


@query(
    "b10_convex_mix",
    sql(
        """SELECT series_id, protocol, fold, arg_min(w, (l, w)) AS weight FROM (SELECT t.series_id, t.protocol, t.fold, g.w, round(sum((o.y - g.w*o.Climatology - (1 - g.w)*o.Persistence)**2) / count(*), 9) AS l
        FROM (SELECT DISTINCT series_id, protocol, fold FROM test_h) t JOIN test_h o ON o.series_id = t.series_id AND o.protocol = t.protocol AND o.fold <> t.fold,
        (SELECT unnest(range(0, 201)) * 0.005::DOUBLE AS w) g WHERE o.active AND NOT o.is_missing GROUP BY ALL) GROUP BY ALL"""
    ),
)
def b10_convex_mix(spark, sf):
    rows = observed(_test(spark, sf, H)).where("active")
    return reference.convex_mix(rows, "Climatology", "Persistence")
