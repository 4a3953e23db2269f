import math
from datetime import datetime

import numpy as np
import pytest
from conftest import hourly_panel
from pyspark.sql import functions as F

from panelcast.operators import joins, metrics as M, splits
from panelcast.operators.grid import day_facts
from panelcast.sources.results import read_run, write_run


def pairs(spark, data):
    return spark.createDataFrame(data, "series_id string, y double, yhat double")


def test_perfect_forecast(spark):
    data = [("a", 100.0 * i, 100.0 * i) for i in range(5)] + [("b", 1.0 * i, 0.0) for i in range(5)]
    got = pairs(spark, data).groupBy("series_id").agg(*M.metric_columns(capacity=F.lit(1000.0))).orderBy("series_id").collect()
    assert (got[0]["n"], got[0]["r2"], got[0]["rmse"], got[0]["nmae_pct"]) == (5, 1.0, 0.0, 0.0)
    assert got[1]["r2"] == pytest.approx(1 - 30 / 10) and got[1]["mae"] == 2.0


def test_too_few_constant_or_unfinished_pairs(spark):
    data = [("few", 1.0 * i, 0.0) for i in range(4)] + [("flat", 3.0, 1.0)] * 9 + [("gaps", 1.0 * i, None if i < 4 else 1.0 * i) for i in range(9)]
    data += [("wild", 1.0 * i, 1.0 * i) for i in range(5)] + [("wild", 1.0, x) for x in (float("inf"), float("-inf"), float("nan"))]
    got = {r["series_id"]: r for r in pairs(spark, data).groupBy("series_id").agg(*M.metric_columns()).collect()}
    assert (got["wild"]["n"], got["wild"]["r2"], got["wild"]["rmse"]) == (5, 1.0, 0.0)
    assert got["few"]["r2"] is None and got["few"]["n"] == 4
    assert got["flat"]["rmse"] is None
    assert got["gaps"]["n"] == 5 and got["gaps"]["rmse"] == 0.0


def test_skill_rules(spark):
    data = [("p1", "m", 50.0), ("p1", "ref", 100.0), ("p2", "m", 150.0), ("p2", "ref", 100.0), ("p3", "m", 50.0), ("p3", "ref", 0.0), ("p4", "m", 1.0), ("p5", "m", 200.0), ("p5", "ref", 400.0)]
    df = spark.createDataFrame(data, "p string, model string, rmse double")
    got = {(r["p"], r["model"]): r["skill"] for r in M.add_skill(df, "ref", ["p"]).collect()}
    assert got["p1", "m"] == 0.5 and got["p1", "ref"] == 0.0 and got["p2", "m"] < 0
    assert got["p3", "m"] is None and got["p4", "m"] is None and got["p5", "m"] == 0.5


# Published scores of one protocol (active hours).
PUBLISHED = {
    "Ridge": (246.91206751850797, 0.178956677745015),
    "NNLSStack": (206.75548474695552, 0.3124871870494714),
    "BestSingleByVal": (221.5028231665638, 0.2634486615041529),
    "SmartPersistence": (300.7296458369177, 0.0),
}
SEED_RMSE = {
    "NNLSStack": [206.75548474695552, 205.7968457653841, 209.84714323714033, 205.35447020290636, 210.49267391708042],
    "SmartPersistence": [300.7296458369177, 300.94748754352406, 300.4522631157287, 301.0527869182686, 300.6472117408893],
}


def test_published_skill_and_gain(spark):
    df = spark.createDataFrame([("p", m, v[0]) for m, v in PUBLISHED.items()], "p string, model string, rmse double")
    for r in M.add_skill(df, "SmartPersistence", ["p"]).collect():
        assert r["skill"] == pytest.approx(PUBLISHED[r["model"]][1], abs=1e-14)
    g = M.gain(F.lit(PUBLISHED["NNLSStack"][0]), F.lit(PUBLISHED["BestSingleByVal"][0]))
    got = spark.range(1).select(*[c.alias(n) for n, c in g.items()]).first()
    assert got["abs_rmse_gain"] == pytest.approx(14.747338419608269, abs=1e-10)
    assert got["rel_rmse_gain_pct"] == pytest.approx(6.657855736908008, abs=1e-10)
    z = M.gain(F.lit(90.0), F.lit(0.0))
    assert spark.range(1).select(*z.values()).first()[0] is None


def test_published_seed_summary(spark):
    df = spark.createDataFrame([("p", m, s, v) for m, vs in SEED_RMSE.items() for s, v in enumerate(vs)], "p string, model string, seed int, rmse double")
    runs = M.add_skill(M.summarise_runs(df, ["p", "model"], ["rmse"], "seed"), "SmartPersistence", ["p"], rmse="rmse_mean")
    got = {r["model"]: r for r in runs.collect()}["NNLSStack"]
    assert got["rmse_mean"] == pytest.approx(207.64932357389335, abs=1e-10)
    assert got["rmse_sd"] == pytest.approx(2.3670670839748245, abs=1e-10)
    assert got["n_runs"] == 5 and got["skill"] == pytest.approx(0.3095981357897133, abs=1e-12)


def test_published_degradation_pivot(spark):
    # nRMSE of smart persistence under four driver products.
    v = {"analysis_full": 18.070027406591215, "analysis_matched": 18.070027406591215, "era5_full": 17.928430007168235, "forecast_day1": 21.044294182163476}
    df = spark.createDataFrame([("p", "SmartPersistence", c, x) for c, x in v.items()], "mode string, model string, configuration string, nrmse double")
    got = M.pivot_scores(df, ["mode", "model"], "configuration", "nrmse", sorted(v), 3).first()
    assert tuple(got)[2:] == (18.07, 18.07, 17.928, 21.044)


def test_published_sweep_change(spark):
    # nRMSE per ratio bound and its published change from bound 1.5.
    v = {1.0: (12.402099754939695, -0.021275617458977436), 1.5: (12.423375372398672, 0.0), 2.0: (12.410661481752037, -0.012713890646635306), math.inf: (12.427547932895845, 0.004172560497172739)}
    df = spark.createDataFrame([("p", b, x[0]) for b, x in v.items()], "mode string, bound double, nrmse double")
    for r in M.sweep_spread(df, ["mode"], "bound", "nrmse", 1.5).collect():
        assert r["change"] == pytest.approx(v[r["bound"]][1], abs=1e-13)
        assert r["spread"] == pytest.approx(12.427547932895845 - 12.402099754939695)


def test_published_best_base(spark):
    # Base-learner scores of one configuration.
    df = spark.createDataFrame([("c", "GBM", 13.226037177932842), ("c", "Ridge", 14.836275335146281), ("c", None, None)], "c string, model string, rmse double")
    got = M.best_per_group(df, ["c"]).collect()
    assert [(r["model"], r["rmse"]) for r in got] == [("GBM", 13.226037177932842)]


def test_drift_check_reports_unmatched(spark):
    e = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "k string, v double")
    a = spark.createDataFrame([("a", 1.005), ("b", 2.5), ("d", 4.0)], "k string, v double")
    got = {r["k"]: r["verdict"] for r in M.drift_check(e, a, ["k"], "v", 0.01).collect()}
    assert got == {"a": "ok", "b": "mismatch", "c": "not computed", "d": "not expected"}


def test_autocorrelation_brute_force(spark):
    rng = np.random.default_rng(0)
    y = np.sin(np.arange(300) * 2 * np.pi / 24) + rng.normal(0, 0.1, 300)
    y[rng.random(300) < 0.2] = np.nan
    ys = [None if np.isnan(v) else float(v) for v in y]
    got = {r["lag"]: r["acf"] for r in M.autocorrelation(hourly_panel(spark, {"a": ys, "b": [1.0, 5.0] * 150}), 30).where("series_id = 'a'").collect()}
    d = y - np.nanmean(y)
    for k in range(31):
        p = d[: len(d) - k] * d[k:]
        p = p[np.isfinite(p)]
        want = p.mean() / np.nanvar(y) if len(p) > 100 else 0.0
        assert got[k] == pytest.approx(want, abs=1e-12)


def test_power_peaks_at_the_planted_period(spark):
    ys = [math.cos(2 * math.pi * i / 24) for i in range(24 * 28)]
    got = {r["period"]: r["power"] for r in M.period_power(hourly_panel(spark, {"a": ys}), [12, 24, 168]).collect()}
    assert got[24] == pytest.approx(0.25) and got[12] < 1e-20 and got[168] < 1e-20


def test_two_by_two(spark):
    df = spark.createDataFrame([("k", True, True, 1.0), ("k", True, False, 3.0), ("k", False, True, 4.0), ("k", False, False, 5.0)], "k string, a boolean, b boolean, v double")
    r = M.two_by_two(df, ["k"], "a", "b", "v").first()
    assert (r["effect_with"], r["effect_without"], r["interaction"]) == (-3.0, -2.0, -1.0)


def test_pivot_has_every_series_and_fixed_columns(spark, monkeypatch):
    from panelcast.queries import models

    off = {"now": 1.0, "late": 3.0, "other": 2.0}
    data = [(c, s, "fold", "Persistence", float(i), float(i) + e, 100.0, True, False) for s in ("click", "view", "refund") for c, e in off.items() for i in range(6)]
    data += [("now", "late only", "fold", "Persistence", 1.0 * i, 1.0 * i, 100.0, True, False) for i in range(6)]
    kind = "config string, series_id string, protocol string, model string, y double, yhat double, capacity double, active boolean, is_missing boolean"
    monkeypatch.setattr(models, "_products", lambda *a: spark.createDataFrame(data, kind))
    out = models.x19_degradation_pivot(spark, None)
    assert out.columns == ["series_id", "protocol", "model", "analysis_full", "analysis_matched", "day_ahead", "reanalysis_full"]
    got = {r["series_id"]: tuple(r)[3:] for r in out.collect()}
    assert {s: got[s] for s in ("click", "view", "refund")} == dict.fromkeys(("click", "view", "refund"), (1.0, 1.0, 3.0, 2.0))
    assert got["late only"] == (0.0, 0.0, None, None)


def test_membership_counts_training_and_validation_apart(spark):
    ys = {"a": [None if h % 31 == 0 else float(h % 50) for h in range(24 * 70)], "b": [float(h % 11) for h in range(24 * 70)]}
    panel = hourly_panel(spark, ys, datetime(2025, 5, 20)).withColumn("active", F.hour("ts") > 3)
    folds = splits.both_protocols(day_facts(panel), {"n_folds": 3, "first_test_days": 14}, {"n_folds": 4})
    assigned = splits.assign(panel, folds)
    cell = {"m": F.month("ts"), "s": F.hour("ts")}
    cells = joins.training_cells(assigned, cell)
    scored = M.observed(splits.eval_rows(assigned)).where("role = 'test' and active").withColumns(cell)
    got = {(r["protocol"], r["fold"]): r for r in M.membership_audit(scored, cells, ["m", "s"], ["s"]).collect()}
    pdf = panel.where("not is_missing").withColumns(cell).withColumn("day", F.to_date("ts")).toPandas()
    joined = pdf.merge(folds.toPandas(), on=["series_id", "day"])
    want = {}
    for (p, f), g in joined.groupby(["protocol", "fold"]):
        test = g[(g.role == "test") & g.active]
        for of, roles in (("train", ["train"]), ("both", ["train", "val"])):
            own = g[g.role.isin(roles)]
            seen, slots = set(zip(own.series_id, own.m, own.s)), set(zip(own.series_id, own.s))
            for key, n in ((f"unseen_cell_{of}", sum(x not in seen for x in zip(test.series_id, test.m, test.s))), (f"unseen_slot_{of}", sum(x not in slots for x in zip(test.series_id, test.s)))):
                assert got[p, f][key] == n
                want[p, key] = want.get((p, key), 0) + n
        assert got[p, f]["scored"] == len(test)
    for (p, key), n in want.items():
        assert got[p, "ALL"][key] == n
    assert want["rolling_origin", "unseen_cell_train"] > want["rolling_origin", "unseen_cell_both"]


def test_a_run_is_checked_against_what_an_earlier_run_stored(spark, tmp_path):
    scores = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "model string, rmse double")
    path = f"file://{tmp_path}/runs"
    for run, table in {"expected": scores, "same": scores, "new": scores.where("model <> 'a'").withColumn("rmse", F.col("rmse") + 0.5)}.items():
        write_run(table, path, run)
    check = lambda run: {r["model"]: r["verdict"] for r in M.drift_check(read_run(spark, path, "expected"), read_run(spark, path, run), ["model"], "rmse", 0.01).collect()}
    assert check("same") == {"a": "ok", "b": "ok", "c": "ok"}
    assert check("new") == {"a": "not computed", "b": "mismatch", "c": "ok"}
    write_run(scores, path, "new")  # a rewrite replaces its own run only
    assert check("new") == {"a": "ok", "b": "ok", "c": "ok"} and read_run(spark, path, "expected").count() == 3
