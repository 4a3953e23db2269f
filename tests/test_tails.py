"""Quantiles over sets of folds, sliding windows, breakpoints: against plain computation, and their plans."""

import math
import random

import numpy as np
import pytest
from conftest import hourly_panel
from pyspark.sql import functions as F

from panelcast.functions.quantiles import exact_quantiles
from panelcast.functions.sliding import circular_quantiles, trailing_quantiles
from panelcast.functions.time import HOURLY
from panelcast.operators import align, features, grid, metrics as M, quality, splits, value
from panelcast.operators.grid import day_facts


def plan(df):
    return df._jdf.queryExecution().toString()


def test_quantiles_of_overlapping_groups(spark):
    rng = random.Random(1)
    sets = [["a"], ["a", "b"], ["b", "c", "d"], []]
    rows = [(k, rng.choice([rng.uniform(-5, 900), float(rng.randrange(4)), 0.0]), rng.choice(sets)) for k in "xy" for _ in range(700)]
    rows += [("x", None, ["a"]), ("z", 7.5, ["d"])]
    df = spark.createDataFrame([(k, v, [(g, g + "1") for g in s]) for k, v, s in rows], "k string, v double, s array<struct<p: string, f: string>>")
    got = {(r["k"], r["p"], r["prob"]): (r["value"], r["n"]) for r in exact_quantiles(df, ["k"], "v", [0.0, 0.37, 0.999, 1.0], "s").collect()}
    want = {}
    for k in "xyz":
        for g in "abcd":
            own = [v for kk, v, s in rows if kk == k and g in s and v is not None]
            want |= {(k, g, q): (pytest.approx(np.quantile(own, q)), len(own)) for q in (0.0, 0.37, 0.999, 1.0) if own}
    assert got == want


@pytest.fixture(scope="module")
def assigned(spark):
    rng = np.random.default_rng(3)
    ys = {s: [None if rng.random() < 0.1 else float(v) for v in rng.gamma(2, 40, 24 * 40)] for s in "ab"}
    panel = hourly_panel(spark, ys).withColumns({"active": F.hour("ts").between(6, 18), "capacity": F.lit(500.0), "driver": F.col("slot") % 97})
    folds = splits.both_protocols(day_facts(panel), {"n_folds": 2, "first_test_days": 20}, {"n_folds": 3})
    return panel.cache(), splits.assign(panel, folds).cache(), folds


def test_fold_capacity_is_that_of_its_rows(spark, assigned):
    _, rows, _ = assigned
    overall = rows.groupBy("series_id").agg(F.max("capacity").alias("capacity"))
    out = splits.fold_capacity(rows, overall, q=0.93)
    pdf = splits.train_rows(rows).select("series_id", "protocol", "fold", "y_filled").toPandas()
    want = {k: (len(g), pytest.approx(g.y_filled.quantile(0.93))) for k, g in pdf.groupby(["series_id", "protocol", "fold"])}
    assert {(r["series_id"], r["protocol"], r["fold"]): (r["n_train"], r["capacity"]) for r in out.collect()} == want
    assert "percentile" not in plan(out)
    few = splits.fold_capacity(rows, overall, min_rows=10**6)
    assert {r["capacity"] for r in few.collect()} == {500.0}


def test_shift_scan_by_fold_against_pooled_rows(spark, assigned):
    panel, _, folds = assigned
    out = align.shift_scan_by_fold(panel, folds, shifts=(-1, 0), q=0.9, min_rows=10)
    assert "percentile" not in plan(out)
    pdf = panel.select("series_id", "slot", "y", "active", "driver", F.col("ts").cast("date").alias("day")).toPandas()
    days = folds.where("role <> 'test'").select("series_id", "protocol", "fold", "day").distinct().toPandas()
    got = {(r["series_id"], r["protocol"], r["fold"], r["shift"]): r for r in out.collect()}
    assert len(got) == 2 * len(days[["series_id", "protocol", "fold"]].drop_duplicates())
    scan = align.shift_pairs(panel, (-1, 0), ["ts"]).where("y is not null").withColumn("day", F.col("ts").cast("date")).toPandas()
    for key, r in list(got.items())[::3]:
        mine = scan[(scan.series_id == key[0]) & (scan["shift"] == key[3])].merge(days[(days.series_id == key[0]) & (days.protocol == key[1]) & (days.fold == key[2])], on=["series_id", "day"])
        cap = mine.y.quantile(0.9)
        act = mine[mine.active]
        r2 = 1 - ((act.y - cap * act.driver / 1000) ** 2).sum() / ((act.y - act.y.mean()) ** 2).sum()
        assert r["capacity"] == pytest.approx(cap) and r["n"] == len(act) and r["r2"] == pytest.approx(r2)
    assert len(pdf) == panel.count()


def test_no_task_holds_a_series_for_its_capacity(assigned):
    out = grid.capacity(assigned[0])
    assert "percentile" not in plan(out) and out.count() == 2


def test_sliding_quantiles_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        n, width, q = rng.randrange(1, 80), rng.randrange(1, 30), rng.choice([0.0, 0.5, 0.95, 1.0])
        slots = sorted(rng.sample(range(150), n))
        values = [float(rng.randrange(9)) for _ in slots]
        want = [np.quantile([v for s, v in zip(slots, values) if t - width < s <= t], q) for t in slots]
        assert trailing_quantiles(slots, values, width, q) == pytest.approx(want)
        circle = [[float(rng.randrange(9)) for _ in range(rng.randrange(3))] for _ in range(rng.randrange(1, 40))]
        half = rng.randrange(0, 12)
        found = circular_quantiles(circle, half, q)
        for k, got in enumerate(found):
            near = {(k + d) % len(circle) for d in range(-half, half + 1)}
            pool = [v for i in near for v in circle[i]]
            assert (got is None) == (not pool) and (not pool or got == pytest.approx(np.quantile(pool, q)))


@pytest.mark.parametrize("width", [30, 64, 10_000])
def test_rolling_quantile_for_any_chunk_width(spark, assigned, width):
    out = quality.rolling_quantile(assigned[0], 24, 0.9, width)
    pdf = assigned[0].select("series_id", "slot", "y_filled").toPandas().sort_values(["series_id", "slot"])
    want = pdf.groupby("series_id").y_filled.rolling(24, min_periods=1).quantile(0.9).to_numpy()
    got = out.orderBy("series_id", "slot").toPandas()
    assert got.rolling_q.to_numpy() == pytest.approx(want) and len(got) == len(pdf)


@pytest.mark.parametrize("width", [40, 333, 8192])
def test_autocorrelation_for_any_chunk_width(spark, assigned, width):
    got = {(r["series_id"], r["lag"]): (r["n"], r["acf"]) for r in M.autocorrelation(assigned[0], 30, 50, width).collect()}
    pdf = assigned[0].toPandas()
    for s in "ab":
        y = pdf[pdf.series_id == s].sort_values("slot").y.to_numpy()
        d = y - np.nanmean(y)
        for lag in (0, 1, 7, 30):
            pair = d[lag:] * d[: len(d) - lag]
            n = int(np.isfinite(pair).sum())
            assert got[s, lag] == (n, pytest.approx(np.nanmean(pair) / np.nanvar(y)))
    assert len(got) == 62
    text = plan(M.autocorrelation(assigned[0], 30))
    assert "collect_list" not in text


def test_envelope_keeps_no_array_of_values(assigned):
    text = plan(features.upper_envelope(assigned[0], HOURLY))
    assert "collect_list" not in text and "flatten" not in text


def test_tuned_cost_against_every_factor(spark):
    rng = random.Random(6)
    rows = [("s", f"F{i % 3}", rng.choice([0.0, -1.0, rng.uniform(0, 9), 5.0]), rng.choice([0.0, -2.0, rng.uniform(0, 9), 5.0, 1e-300]), i % 17 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "series_id string, fold string, y double, yhat double, is_missing boolean")
    got = {r["ratio"]: r for r in value.tuned_cost(df, ["series_id"], lo=20, hi=150).collect()}

    def parts(fold, pct, inside):
        own = [(y, max(yhat * pct / 100, 0)) for _, f, y, yhat, gone in rows if not gone and (f == fold) == inside]
        return sum(max(c - y, 0) for y, c in own), sum(max(y - c, 0) for y, c in own), sum(y for y, _ in own)

    for ratio in (2.0, 3.0, 5.0):
        total, delivered, scales = 0.0, 0.0, []
        for fold in ("F0", "F1", "F2"):
            cost = {}
            for pct in range(20, 151):
                s, u, d = parts(fold, pct, False)
                cost[pct] = round((ratio * s + u) / d, 9)
            best = min(cost, key=lambda p: (cost[p], p))
            s, u, d = parts(fold, best, True)
            total, delivered = total + ratio * s + u, delivered + d
            scales.append(best / 100)
        assert got[ratio]["tuned_cost"] == pytest.approx(total / delivered) and got[ratio]["mean_scale"] == pytest.approx(math.fsum(scales) / 3)


