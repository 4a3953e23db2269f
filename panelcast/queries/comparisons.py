"""Significance, fallback audits and commitment value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.time import DAILY, season_slot
from ..operators import inference, joins, metrics as M, value
from ..plans.backtest import scored_frame
from ..plans.datasets import D, E, H, stored_frame, stored_fused
from .registry import query, tidy
from .scores import pred, test_rows
from .sql import r, sql

_G = "series_id, protocol, subset"
_K = ["series_id", "protocol", "subset"]


def _dm(a: str, b: str, src: str, loss: str = "squared", keys: str = _G) -> str:
    d = f"((y - {a})**2 - (y - {b})**2)" if loss == "squared" else f"(abs(y - {a}) - abs(y - {b}))"
    return f"""SELECT {keys}, count(*) AS n, avg({d}) AS mean_diff,
    CASE WHEN count(*) >= 8 AND var_samp({d}) > 0 THEN avg({d}) / sqrt(var_samp({d}) / count(*)) END AS statistic FROM {src} GROUP BY ALL"""


@query("x08_dm_statistic", sql(f"SELECT {_G}, n, {r('mean_diff', 4)} AS mean_diff, {r('statistic')} AS statistic FROM ({_dm('OLS2', 'Persistence', 'pair_h')})"))
def x08_dm_statistic(spark, sf):
    rows = M.with_subsets(M.observed(test_rows(spark, sf)))
    out = inference.dm_statistic(rows, _K, "OLS2", "Persistence")
    return tidy(out.select(*_K, "n", "mean_diff", "statistic"), 6, mean_diff=4)


@query("x08_dm_absolute", sql(f"SELECT {_G}, n, {r('statistic')} AS statistic FROM ({_dm('Climatology', 'SmartPersistence', 'pair_d', 'absolute')})"))
def x08_dm_absolute(spark, sf):
    rows = M.with_subsets(M.observed(test_rows(spark, sf, D)))
    return tidy(inference.dm_statistic(rows, _K, "Climatology", "SmartPersistence", "absolute").select(*_K, "n", "statistic"))


@query("x08_dm_verdict")
def x08_dm_verdict(spark, sf):
    rows = M.with_subsets(M.observed(test_rows(spark, sf)))
    return tidy(inference.diebold_mariano(rows, _K, "OLS2", "Persistence"))


def _boot(src: str, keys: str, a: str, b: str, widths: str, n_boot: int) -> str:
    u = ", ".join(k.strip() for k in keys.split(","))
    on = " AND ".join(f"x.{k.strip()} = y.{k.strip()}" for k in (keys + ", block_days").split(","))
    days = f"""SELECT {u}, day, sum((y - {a})**2) AS la, sum((y - {b})**2) AS lb, count(*) AS n,
        row_number() OVER (PARTITION BY {u} ORDER BY day) - 1 AS p FROM {src} GROUP BY {u}, day"""
    blocks = f"SELECT {u}, block_days, p // block_days AS b, sum(la) AS la, sum(lb) AS lb, sum(n) AS n, count(*) AS d FROM ({days}), (SELECT unnest([{widths}]) AS block_days) GROUP BY ALL"
    tot = f"SELECT {u}, block_days, count(*) AS m, sum(d)::BIGINT AS n_days, sum(n)::BIGINT AS n, sum(la) AS la, sum(lb) AS lb FROM ({blocks}) GROUP BY ALL"
    reps = f"""SELECT {', '.join(f'x.{k.strip()}' for k in keys.split(','))}, x.block_days, rep, sum(y.la) AS a, sum(y.lb) AS b, sum(y.n) AS n FROM
        (SELECT *, CAST('0x' || substr(md5('0|' || rep || '|' || j), 1, 8) AS BIGINT) % m AS pick FROM
          (SELECT *, unnest(range(0, m)) AS j FROM (SELECT *, unnest(range(0, {n_boot})) AS rep FROM ({tot}) WHERE n_days >= 8))) x
        JOIN ({blocks}) y ON {on} AND y.b = x.pick GROUP BY ALL"""
    boot = f"""SELECT {u}, block_days, quantile_cont((1 - sqrt(a)/sqrt(b))*100, 0.025) AS lo, quantile_cont((1 - sqrt(a)/sqrt(b))*100, 0.975) AS hi,
        least(greatest(2*least(avg((a - b >= 0)::INT), avg((a - b <= 0)::INT)), {1.0 / n_boot}), 1.0) AS p FROM ({reps}) GROUP BY ALL"""
    sel = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    return f"""SELECT {sel}, x.block_days, {r('CASE WHEN n_days >= 8 THEN (sqrt(x.lb) - sqrt(x.la))/sqrt(x.lb)*100 END')} AS rel_rmse_gain_pct,
        n_days, x.n, {r('y.lo')} AS ci_low_pct, {r('y.hi')} AS ci_high_pct, {r('y.p')} AS p_value FROM ({tot}) x LEFT JOIN ({boot}) y ON {on}"""


@query("x09_day_bootstrap", sql(_boot("pair_h", _G, "OLS2", "Persistence", "1", 10000)))
def x09_day_bootstrap(spark, sf):
    rows = M.with_subsets(M.observed(test_rows(spark, sf)))
    days = inference.day_losses(rows, _K, "OLS2", "Persistence")
    return tidy(inference.block_bootstrap(days, _K))


_ENS = ["Mean", "InvRMSE", "RidgeStack", "NNLSStack", "BestSingleByVal"]
_BASE = ["Scaled", "OLS2"]


def _lowest(names: list[str], tag: str) -> str:
    lst, vals = ", ".join(f"'{m}'" for m in names), ", ".join(names)
    return f"""(SELECT {_G}, model AS lowest_{tag}, rmse AS lowest_{tag}_rmse FROM (SELECT {_G}, model, sqrt(avg((y - yhat)**2)) AS rmse FROM
    (SELECT {_G}, y, unnest([{lst}]) AS model, unnest([{vals}]) AS yhat FROM fpair) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {_G} ORDER BY round(rmse, 7), model) = 1)"""


_FPAIR = "(SELECT *, unnest(CASE WHEN active THEN ['ALL', 'active'] ELSE ['ALL'] END) AS subset FROM fused_h WHERE NOT is_missing)"


@query(
    "x11_significance",
    sql(
        f"""SELECT b.* EXCLUDE (block_days), {r('g.gain', 4)} AS abs_rmse_gain, {r('d.statistic', 4)} AS dm_statistic_hourly,
        lowest_base, {r('lowest_base_rmse', 4)} AS lowest_base_rmse, lowest_ensemble, {r('lowest_ensemble_rmse', 4)} AS lowest_ensemble_rmse
        FROM ({_boot(_FPAIR, _G, 'NNLSStack', 'BestSingleByVal', '1', 10000)}) b
        JOIN (SELECT {_G}, sqrt(avg((y - BestSingleByVal)**2)) - sqrt(avg((y - NNLSStack)**2)) AS gain FROM {_FPAIR} GROUP BY ALL) g USING ({_G})
        JOIN ({_dm('NNLSStack', 'BestSingleByVal', _FPAIR)}) d USING ({_G})
        JOIN {_lowest(_BASE, 'base').replace('fpair', _FPAIR)} USING ({_G}) JOIN {_lowest(_ENS, 'ensemble').replace('fpair', _FPAIR)} USING ({_G})"""
    ).replace("b.* EXCLUDE (block_days)", "series_id, protocol, subset, rel_rmse_gain_pct, n_days, b.n AS n, ci_low_pct, ci_high_pct, p_value"),
)
def x11_significance(spark, sf):
    out = inference.significance_table(
        stored_fused(spark, sf, H), "NNLSStack", "BestSingleByVal", _BASE, _ENS
    )
    return tidy(out, 6, abs_rmse_gain=4, dm_statistic_hourly=4, lowest_base_rmse=4, lowest_ensemble_rmse=4)


@query(
    "x12_block_widths",
    sql(
        f"""SELECT 'Climatology' AS comparator, * FROM ({_boot("(SELECT * FROM pair_h WHERE subset = 'active')", 'series_id, protocol', 'OLS2', 'Climatology', '1, 3, 7', 10000)})
        UNION ALL SELECT 'Persistence', * FROM ({_boot("(SELECT * FROM pair_h WHERE subset = 'active')", 'series_id, protocol', 'OLS2', 'Persistence', '1, 3, 7', 10000)})"""
    ),
)
def x12_block_widths(spark, sf):
    rows = M.observed(test_rows(spark, sf)).where("active")
    keys = ["comparator", "series_id", "protocol"]
    both = M.to_long(rows.select("series_id", "protocol", "ts", "y", "OLS2", "Climatology", "Persistence"), ["Climatology", "Persistence"])
    days = inference.day_losses(both.withColumnRenamed("model", "comparator"), keys, "OLS2", "yhat")
    return tidy(inference.block_bootstrap(days, keys, widths=(1, 3, 7)))


_AUDIT = {"lag_missing": "lag_seen", "lookback_exhausted": "back_seen", "unseen_cell": "cell_seen", "unseen_slot": "slot_seen"}


@query(
    "x13_fallback_audit",
    sql(
        "SELECT protocol, coalesce(fold, 'ALL') AS fold, count(*) AS scored, "
        + ", ".join(f"count(*) FILTER (WHERE NOT {c}) AS {n}, {r(f'100.0 * count(*) FILTER (WHERE NOT {c}) / count(*)')} AS {n}_pct" for n, c in _AUDIT.items())
        + " FROM test_e WHERE active AND NOT is_missing GROUP BY GROUPING SETS ((protocol, fold), (protocol))"
    ),
)
def x13_fallback_audit(spark, sf):
    return tidy(M.fallback_audit(test_rows(spark, sf, E)))


_KNOWN = "SELECT w.series_id, s.protocol, s.fold, month(ts) AS m, slot % 7 AS s, bool_or(s.role = 'train') AS t FROM whole_e w JOIN splits_e s ON s.series_id = w.series_id AND s.day = w.day AND s.role <> 'test' WHERE NOT is_missing GROUP BY ALL"


@query(
    "x13_membership_audit",
    sql(
        f"""SELECT e.protocol, coalesce(e.fold, 'ALL') AS fold, count(*) AS scored, count(*) FILTER (WHERE NOT coalesce(c.t, false)) AS unseen_cell_train, count(*) FILTER (WHERE c.t IS NULL) AS unseen_cell_both,
        count(*) FILTER (WHERE NOT coalesce(k.t, false)) AS unseen_slot_train, count(*) FILTER (WHERE k.t IS NULL) AS unseen_slot_both FROM test_e e
        LEFT JOIN ({_KNOWN}) c ON c.series_id = e.series_id AND c.protocol = e.protocol AND c.fold = e.fold AND c.m = month(e.ts) AND c.s = e.slot % 7
        LEFT JOIN (SELECT series_id, protocol, fold, s, bool_or(t) AS t FROM ({_KNOWN}) GROUP BY ALL) k ON k.series_id = e.series_id AND k.protocol = e.protocol AND k.fold = e.fold AND k.s = e.slot % 7
        WHERE active AND NOT is_missing GROUP BY GROUPING SETS ((e.protocol, e.fold), (e.protocol))"""
    ),
)
def x13_membership_audit(spark, sf):
    """What a fold has not observed among its training rows, and among those and its validation rows."""
    assigned, _ = scored_frame(stored_frame(spark, sf, E), E.setup)
    cell = {"m": F.month("ts"), "s": season_slot(F.col("slot"), DAILY)}
    scored = M.observed(test_rows(spark, sf, E)).where("active").withColumns(cell)
    return M.membership_audit(scored, joins.training_cells(assigned, cell), ["m", "s"], ["s"])


@query(
    "x14_lag_observed",
    sql(
        f"""SELECT series_id, protocol, tag, model, count(*) AS n, {r('100.0 * count(*) / max(count(*)) OVER (PARTITION BY series_id, protocol)')} AS pct_of_scored, {r('sqrt(avg((y - yhat)**2))')} AS rmse,
        {r("1 - sqrt(avg((y - yhat)**2)) / max(sqrt(avg((y - yhat)**2))) FILTER (WHERE model = 'SmartPersistence') OVER (PARTITION BY series_id, protocol, tag)")} AS skill
        FROM (SELECT *, unnest(CASE WHEN lag_seen THEN ['all scored', 'lag observed'] ELSE ['all scored'] END) AS tag FROM obs_h WHERE active) GROUP BY series_id, protocol, tag, model"""
    ),
)
def x14_lag_observed(spark, sf):
    return tidy(M.lag_observed_scores(pred(spark, sf), "SmartPersistence"))


_COST = """SELECT series_id, protocol, model, ratio, CASE WHEN sum(y) > 0 THEN (ratio * sum(greatest(greatest(yhat, 0) - y, 0)) + sum(greatest(y - greatest(yhat, 0), 0))) / sum(y) END AS cost
    FROM obs_h, (SELECT unnest([1.0, 2.0, 3.0, 5.0]::DOUBLE[]) AS ratio) GROUP BY series_id, protocol, model, ratio"""


@query("x15_commitment_cost", sql(f"SELECT series_id, protocol, model, ratio, {r('cost')} AS cost FROM ({_COST})"))
def x15_commitment_cost(spark, sf):
    return tidy(value.commitment_cost(pred(spark, sf), ["series_id", "protocol", "model"]))


_SCALE = """SELECT *, arg_min(pct, (round((ratio * os + ou) / od, 9), pct)) OVER (PARTITION BY series_id, protocol, model, fold, ratio) AS best FROM (
    SELECT x.*, ratio, sum(s) OVER w - s AS os, sum(u) OVER w - u AS ou, sum(d) OVER w - d AS od FROM (
    SELECT series_id, protocol, model, fold, pct, sum(greatest(greatest(yhat * (pct / 100.0::DOUBLE), 0) - y, 0)) AS s, sum(greatest(y - greatest(yhat * (pct / 100.0::DOUBLE), 0), 0)) AS u, sum(y) AS d
    FROM obs_h, (SELECT unnest(range(20, 151)) AS pct) GROUP BY ALL) x, (SELECT unnest([2.0, 3.0, 5.0]::DOUBLE[]) AS ratio) WINDOW w AS (PARTITION BY series_id, protocol, model, pct, ratio))"""
_TUNED = f"SELECT series_id, protocol, model, ratio, sum(ratio * s + u) / sum(d) AS tuned_cost, avg(pct) / 100 AS mean_scale FROM ({_SCALE}) WHERE pct = best GROUP BY ALL"


@query("x16_tuned_scale", sql(f"SELECT series_id, protocol, model, ratio, {r('tuned_cost')} AS tuned_cost, {r('mean_scale')} AS mean_scale FROM ({_TUNED})"))
def x16_tuned_scale(spark, sf):
    return tidy(value.tuned_cost(pred(spark, sf), ["series_id", "protocol", "model"]))


@query(
    "x17_cost_skill",
    sql(
        f"""SELECT c.series_id, c.protocol, c.model, c.ratio, {r('cost')} AS cost, {r('tuned_cost')} AS tuned_cost, {r('mean_scale')} AS mean_scale,
        {r('CASE WHEN cost > 0 THEN 100 * (cost - tuned_cost) / cost END')} AS saving_pct,
        {r("1 - cost / max(cost) FILTER (WHERE c.model = 'SmartPersistence') OVER (PARTITION BY c.series_id, c.protocol, c.ratio)")} AS cost_skill
        FROM ({_COST}) c LEFT JOIN ({_TUNED}) t ON t.series_id = c.series_id AND t.protocol = c.protocol AND t.model = c.model AND t.ratio = c.ratio"""
    ),
)
def x17_cost_skill(spark, sf):
    keys = ["series_id", "protocol", "model"]
    return tidy(value.value_table(pred(spark, sf), keys, "SmartPersistence", ["series_id", "protocol"]))
