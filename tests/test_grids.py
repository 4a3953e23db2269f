"""Grids whose settings are keys: products, feature blocks, mask arms."""

from datetime import timedelta

import numpy as np
import pytest
from conftest import START, START_SLOT, hourly_panel
from pyspark.sql import functions as F

from panelcast.functions.special import t_two_sided
from panelcast.functions.stage import stage
from panelcast.operators import splits
from panelcast.operators.grid import day_facts
from panelcast.plans import grids, masks, products


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(11)
    n = 24 * 45
    x1, x2 = rng.gamma(2.0, 50.0, n), rng.normal(10, 3, n)
    x2n = [None if rng.random() < 0.2 else float(v) for v in x2]
    ys = {s: [None if rng.random() < 0.15 else float(max(k * u + 4 * v + e, 0)) for u, v, e in zip(x1, x2, rng.normal(0, 5, n))] for s, k in (("a", 1.0), ("b", 2.0))}
    out = hourly_panel(spark, ys, extra={"x1 double": x1.tolist(), "x2 double": x2n, "driver double": x1.tolist()})
    return out.withColumns({"active": F.hour("ts").between(6, 18), "capacity": F.lit(400.0)}).cache()


@pytest.fixture(scope="module")
def folds(panel):
    return splits.both_protocols(day_facts(panel), {"n_folds": 2, "first_test_days": 25}, {"n_folds": 3}).cache()


@pytest.fixture(scope="module")
def assigned(panel, folds):
    return splits.assign(panel, folds).cache()


def plain_ridge(x, y, w=None):
    w = np.ones(len(y)) if w is None else w
    m, n = (w[:, None] * x).sum(0) / w.sum(), w.sum()
    c, t = x - m, y - (w * y).sum() / n
    sd = np.sqrt((w[:, None] * c * c).sum(0) / n)
    sd[sd < 1e-12] = 1.0
    z = c / sd
    beta = np.linalg.solve(z.T @ (w[:, None] * z) + np.eye(x.shape[1]), z.T @ (w * t)) / sd
    return np.r_[(w * y).sum() / n - beta @ m, beta]


def test_each_block_is_fitted_on_the_rows_that_have_it(assigned):
    variants = {"both": ["x1", "x2"], "first": ["x1"], "second": ["x2"]}
    coefs, union = grids.ridge_variants(assigned, variants)
    train = splits.train_rows(assigned).toPandas()
    for r in coefs.collect():
        mine = train[(train.series_id == r["series_id"]) & (train.protocol == r["protocol"]) & (train.fold == r["fold"])]
        for name, fs in variants.items():
            own = mine.dropna(subset=[*fs, "y"])
            want = plain_ridge(own[fs].to_numpy(), own.y.to_numpy())
            got = [r[name][0], *[r[name][1 + union.index(f)] for f in fs]]
            assert got == pytest.approx(want.tolist(), rel=1e-6)
            assert all(r[name][1 + i] == 0 for i, f in enumerate(union) if f not in fs)


def test_a_missing_value_costs_only_its_own_variants(assigned):
    wide = grids.variant_forecasts(assigned, {"both": ["x1", "x2"], "first": ["x1"]})
    assert wide.where("first is null").count() == 0
    assert wide.where("(both is null) <> (x2 is null)").count() == 0
    assert wide.count() == splits.eval_rows(assigned).where("role = 'test'").count()


def test_pairs_are_priced_on_rows_that_have_both(spark):
    rng = np.random.default_rng(5)
    rows = []
    for p in ("k", "t"):
        for i in range(60):
            y = float(rng.normal(50, 10))
            rows.append(("s", p, i, y, 100.0, i % 10 != 0, i % 7 == 0, y + float(rng.normal(0, 1)), y + float(rng.normal(0, 3)), None if i % 5 == 0 else y + 2.0))
    df = spark.createDataFrame(rows, "series_id string, protocol string, slot int, y double, capacity double, active boolean, is_missing boolean, good double, bad double, gappy double")
    pairs = [("worse", "good", "bad"), ("gaps", "good", "gappy"), ("same", "good", "good")]
    got = {(r["comparison"], r["protocol"]): r for r in grids.price_columns(df, pairs).collect()}
    pdf = df.where("active and not is_missing").toPandas()
    for name, a, b in pairs[:2]:
        for p in ("k", "t"):
            mine = pdf[pdf.protocol == p].dropna(subset=[a, b])
            la, lb = (mine.y - mine[a]) ** 2, (mine.y - mine[b]) ** 2
            d = lb - la
            stat = d.mean() / np.sqrt(d.var(ddof=1) / len(d))
            r = got[name, p]
            assert r["n_common"] == len(mine) and r["statistic"] == pytest.approx(stat)
            assert r["nrmse_change_pp"] == pytest.approx(100 * (np.sqrt(lb.mean()) - np.sqrt(la.mean())) / 100)
            assert r["p_value"] == pytest.approx(t_two_sided(np.array([stat]), np.array([len(d) - 1.0]))[0])
            assert r["better"] == ("reference" if r["p_value"] < 0.05 else "no significant difference")
    assert got["same", "k"]["better"] == "tie"


# Published two-sided tail probabilities (statistic, degrees of freedom, probability).
TAILS = ((1.0, 1.0, 0.5), (2.0, 10.0, 0.07338803), (2.228138852, 10.0, 0.05), (12.7062047, 1.0, 0.05), (1.959963985, 1e7, 0.05), (3.169272673, 10.0, 0.01))


def test_tail_values():
    for t, df, p in TAILS:
        assert t_two_sided(np.array([t]), np.array([df]))[0] == pytest.approx(p, rel=1e-5)
        assert t_two_sided(np.array([-t]), np.array([df]))[0] == pytest.approx(p, rel=1e-5)


def test_products_are_columns_filled_inside_each_span(spark):
    long = hourly_panel(spark, {"a": [1.0] * 10}).withColumns({"first_slot": F.lit(START_SLOT).cast("bigint"), "last_slot": F.lit(START_SLOT + 9).cast("bigint")})
    one = spark.createDataFrame([(START_SLOT + i, float(i)) for i in (2, 5)], "slot bigint, v double")
    two = spark.createDataFrame([(START_SLOT + i, 100.0 + i) for i in (5, 30)], "slot bigint, v double")
    out = products.with_products(long.select("series_id", "slot", "y"), long, {"one": one, "two": two}, ["v"]).orderBy("slot").collect()
    assert [r["v__one"] for r in out] == [2.0] * 5 + [5.0] * 5
    assert [r["v__two"] for r in out] == [105.0] * 10
    assert products.variants({"c": products.Configuration("two", ("v", "w"))}) == {"c": ["v__two", "w__two"]}


def test_mask_arms_are_the_four_weighted_fits(panel, folds):
    rows, plain, seen = masks.hour_rows(panel, folds, ["driver"], history=3)
    rows = stage(rows, "windows")
    fits = masks.fit_arms(rows, plain, seen).collect()
    pdf = rows.toPandas()
    assert len(plain) == 4 and len(seen) == 3 and set(pdf.columns) >= {"masked", "naive", "evaluate"}
    # a window by hand: history of the same hour, zero where hidden or missing
    truth = {(r["series_id"], r["ts"]): (r["y"], r["is_missing"]) for r in panel.select("series_id", "ts", "y", "is_missing").collect()}
    roles = {(r["series_id"], r["protocol"], r["fold"], r["day"]): r["role"] for r in folds.collect()}
    order = sorted({(k[0], k[1], k[2], k[3]) for k in roles})
    by_fold = {}
    for s, p, f, d in order:
        by_fold.setdefault((s, p, f), []).append(d)
    for r in pdf.sample(60, random_state=1).itertuples():
        days = by_fold[r.series_id, r.protocol, r.fold]
        place = days.index(r.day)
        for k in range(3):
            past = days[place - 3 + k]
            y, gone = truth[r.series_id, START.replace(hour=0) + timedelta(days=(past - START.date()).days, hours=r.hour)]
            open_ = roles[r.series_id, r.protocol, r.fold, past] == "train"
            assert getattr(r, f"p{k}") == pytest.approx(y / 400.0 if open_ and not gone else 0.0)
            assert getattr(r, f"a{k}") == float(open_ and not gone)
    for r in fits:
        mine = pdf[(pdf.series_id == r["series_id"]) & (pdf.protocol == r["protocol"]) & (pdf.fold == r["fold"]) & (pdf.role == "train")]
        for arm, (channel, masked) in masks.ARMS.items():
            names = [*plain, *(seen if channel else [])]
            want = plain_ridge(mine[names].to_numpy(), mine.target.to_numpy(), mine["masked" if masked else "naive"].to_numpy())
            assert r[arm][: len(names) + 1] == pytest.approx(want.tolist(), rel=1e-5, abs=1e-8)
            assert all(v == 0 for v in r[arm][len(names) + 1 :])
    forecasts = masks.arm_forecasts(rows, plain, seen)
    assert forecasts.count() == int(((pdf.role == "test") & (pdf.evaluate == 1)).sum())
    scores = masks.score_arms(forecasts).collect()
    assert len(scores) == 4 * 4 and {r["arm"] for r in scores} == set(masks.ARMS)
    out = forecasts.toPandas()
    for r in scores:
        mine = out[(out.series_id == r["series_id"]) & (out.protocol == r["protocol"])]
        assert r["rmse"] == pytest.approx(np.sqrt(((mine.y - mine[r["arm"]]) ** 2).mean())) and r["n"] == len(mine)
        if r["arm"] == masks.NAIVE:
            assert r["hour_statistic"] is None and r["day_statistic"] is None
        else:
            d = (mine.y - mine[r["arm"]]) ** 2 - (mine.y - mine[masks.NAIVE]) ** 2
            assert r["hour_statistic"] == pytest.approx(d.mean() / np.sqrt(d.var(ddof=1) / len(d)))
            per_day = d.groupby(mine.ts.dt.date).mean()
            assert r["n_days"] == len(per_day) and r["day_statistic"] == pytest.approx(per_day.mean() / np.sqrt(per_day.var(ddof=1) / len(per_day)))
