import numpy as np
import pytest
from conftest import hourly_panel
from pyspark.sql import functions as F

from panelcast.functions.solve import nnls_from_gram, ridge_from_moments, simplex_from_gram
from panelcast.operators import boosting, fusion, linear, splits
from panelcast.operators.grid import day_facts
from panelcast.plans import grids


def kkt_nnls(g, h, w, tol=1e-7):
    grad = g @ w - h
    scale = np.abs(h).max()
    assert (w >= 0).all() and (grad >= -tol * scale).all()
    assert np.abs(grad[w > 0]).max(initial=0) < tol * scale


@pytest.mark.parametrize("seed", range(20))
def test_nnls_and_simplex_conditions(seed):
    rng = np.random.default_rng(seed)
    k = int(rng.integers(1, 7))
    a = rng.normal(size=(60, k)) + rng.normal(size=(60, 1)) * 3
    b = a @ np.maximum(rng.normal(size=k), 0) + rng.normal(0, 1, 60)
    g, h = a.T @ a, a.T @ b
    kkt_nnls(g, h, nnls_from_gram(g, h))
    w = simplex_from_gram(g, h)
    assert w.sum() == pytest.approx(1) and (w >= 0).all()
    grad = g @ w - h
    lam = grad[w > 1e-9].mean()
    scale = np.abs(g).max()
    assert np.abs(grad[w > 1e-9] - lam).max() < 1e-6 * scale and (grad >= lam - 1e-6 * scale).all()


def test_nnls_of_useless_members_is_zero():
    a = np.abs(np.random.default_rng(0).normal(size=(30, 2)))
    assert nnls_from_gram(a.T @ a, a.T @ (-np.ones(30))).tolist() == [0, 0]


def test_ridge_moments_equal_direct_solution():
    rng = np.random.default_rng(3)
    x = rng.normal(5, 2, size=(80, 3))
    x[:, 2] = 7.0  # constant column
    y = 3 + x[:, :2] @ [1.5, -2.0] + rng.normal(0, 0.3, 80)
    b0, beta = ridge_from_moments(80, x.sum(0), x.T @ x, y.sum(), x.T @ y, 1.0, True)
    z = (x[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0)
    w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert beta[:2] == pytest.approx(w / x[:, :2].std(0)) and beta[2] == 0
    assert b0 == pytest.approx(y.mean() - beta[:2] @ x[:, :2].mean(0))


@pytest.fixture(scope="module")
def assigned(spark):
    rng = np.random.default_rng(7)
    n = 24 * 40
    x1, x2 = rng.gamma(2.0, 50.0, n), rng.normal(10, 3, n)
    ys = {s: [None if rng.random() < 0.1 else float(max(k * u + 4 * v + e, 0)) for u, v, e in zip(x1, x2, rng.normal(0, 5, n))] for s, k in (("a", 1.0), ("b", 2.0))}
    panel = hourly_panel(spark, ys, extra={"x1 double": x1.tolist(), "x2 double": x2.tolist()}).withColumns({"active": F.hour("ts").between(6, 18), "capacity": F.lit(500.0)})
    folds = splits.both_protocols(day_facts(panel), {"n_folds": 2, "first_test_days": 20}, {"n_folds": 3})
    return splits.assign(panel, folds).cache()


def test_fits_recover_planted_slopes(assigned):
    for r in linear.two_driver_ols(assigned, "x1", "x2").collect():
        assert r["b1"] == pytest.approx(1.0 if r["series_id"] == "a" else 2.0, abs=0.05)
        assert r["b2"] == pytest.approx(4.0, abs=0.5)
    both = linear.fit_together(assigned, ["x1", "x2"], ("x1", "x2"))
    one = {tuple(r)[:3]: r for r in linear.two_driver_ols(assigned, "x1", "x2").collect()}
    slope = {tuple(r)[:3]: r["slope"] for r in linear.through_origin(assigned, "x1").collect()}
    coef = {tuple(r)[:3]: r["coef"] for r in linear.ridge(assigned, ["x1", "x2"]).collect()}
    for r in both.collect():
        k = tuple(r)[:3]
        assert (r["b0"], r["b1"], r["b2"], r["slope"]) == pytest.approx((one[k]["b0"], one[k]["b1"], one[k]["b2"], slope[k]), rel=1e-9)
        assert list(r["coef"]) == pytest.approx(list(coef[k]), rel=1e-9)


def test_collinear_drivers_have_no_ols(assigned):
    got = linear.two_driver_ols(assigned.withColumn("x3", F.col("x1") * 2), "x1", "x3")
    assert got.where("b1 is not null").count() == 0


def test_variants_from_one_pass_equal_separate_fits(assigned):
    coefs, union = grids.ridge_variants(assigned, {"both": ["x1", "x2"], "one": ["x2"]})
    alone = {tuple(r)[:3]: r["coef"] for r in linear.ridge(assigned, ["x2"]).collect()}
    for r in coefs.collect():
        assert union == ["x1", "x2"] and r["one"][1] == 0.0
        assert [r["one"][0], r["one"][2]] == pytest.approx(list(alone[tuple(r)[:3]]), rel=1e-9)


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(11)
    data = []
    for s in ("a", "b"):
        for f in ("T1", "T2", "T3"):
            for role, n in (("val", 120), ("test", 90)):
                y = rng.gamma(2.0, 20.0, n)
                for i, v in enumerate(y):
                    data.append((s, "p", f, role, i, float(v), i % 3 != 0, i % 10 == 0, *(float(v + e) for e in rng.normal(0, [3, 6, 12]))))
    schema = "series_id string, protocol string, fold string, role string, i int, y double, active boolean, is_missing boolean, m1 double, m2 double, m3 double"
    return spark.createDataFrame(data, schema).withColumn("ts", F.expr("timestamp_ntz'2025-01-01' + make_interval(0,0,0,0,i)")).cache()


MEMBERS = ["m1", "m2", "m3"]


def test_fusion_weights_match_direct_solutions(wide):
    pdf = wide.toPandas()
    for r in fusion.fit(wide, MEMBERS).collect():
        g = pdf[(pdf.series_id == r["series_id"]) & (pdf.fold == r["fold"]) & (pdf.role == "val") & pdf.active & ~pdf.is_missing]
        v, y = g[MEMBERS].to_numpy(), g.y.to_numpy()
        kkt_nnls(v.T @ v, v.T @ y, np.array(r["w_nnls"]))
        rmse = np.sqrt(((y[:, None] - v) ** 2).mean(0))
        assert list(r["w_inv"]) == pytest.approx(list((1 / rmse) / (1 / rmse).sum()))
        assert r["best_member"] == int(rmse.argmin())
        c = v - v.mean(0)
        w = np.linalg.solve(c.T @ c + np.eye(3), c.T @ (y - y.mean()))
        assert list(r["w_ridge"])[1:] == pytest.approx(list(w), rel=1e-6)
        assert sum(r["w_nnls_sum1"]) == pytest.approx(1) and sum(r["w_simplex"]) == pytest.approx(1)


def test_fold_without_validation_gets_the_mean(wide):
    fits = fusion.fit(wide.where("not (fold = 'T3' and role = 'val')"), MEMBERS)
    out = fusion.apply(wide, fits, MEMBERS).where("fold = 'T3'")
    assert out.where("abs(NNLSStack - Mean) > 1e-12 or abs(BestSingleByVal - Mean) > 1e-12").count() == 0
    assert fusion.apply(wide, fits, MEMBERS).count() == wide.where("role = 'test'").count()


def test_leave_member_out_brute_force(wide):
    pdf = wide.toPandas()
    pdf = pdf[(pdf.role == "test") & pdf.active & ~pdf.is_missing]
    got = {(r["series_id"], r["model"]): r["rmse_without"] for r in fusion.leave_member_out(wide, MEMBERS).collect()}
    for s in ("a", "b"):
        mine = pdf[pdf.series_id == s]
        for drop in ("ALL", *MEMBERS):
            kept = [m for m in MEMBERS if m != drop]
            err = []
            for f in mine.fold.unique():
                o, h = mine[mine.fold != f], mine[mine.fold == f]
                a = o[kept].to_numpy()
                w = nnls_from_gram(a.T @ a, a.T @ o.y.to_numpy())
                err.append(h.y.to_numpy() - h[kept].to_numpy() @ (w / w.sum()))
            assert got[s, drop] == pytest.approx(np.sqrt((np.concatenate(err) ** 2).mean()), rel=1e-9)


def test_per_hour_stack_uses_equal_weights_for_thin_hours(wide):
    out = fusion.per_hour_stack(wide, MEMBERS, min_rows=10**6)
    assert out.where("abs(PerHourStack - greatest((m1 + m2 + m3) / 3, 0)) > 1e-9").count() == 0


def test_boosting_learns(spark, assigned):
    rows = assigned.drop("prev_pair")
    train = splits.train_rows(rows).where("fold = 'K1'")
    test = splits.eval_rows(rows).where("fold = 'K1' and role = 'test'").where("not is_missing")
    opts = {"rounds": 5, "depth": 3, "rate": 0.5, "min_leaf": 5}
    out = boosting.boosted(train.withColumn("hold", boosting.held_out(0.12, F.col("series_id"), F.col("slot"))), test, ["x1", "x2"], validation="hold", **opts)
    sse, sst = out.agg(F.sum(F.pow(F.col("y") - F.col("GBM"), 2)), F.var_pop("y") * F.count("*")).first()
    assert sse < 0.8 * sst
    ratio = boosting.boosted_ratio(train, test, ["x1", "x2"], "x1", F.lit(1000.0), **opts)
    assert ratio.where("x1 < 50 and GBM_kt <> 0").count() == 0 and ratio.where("GBM_kt > 0").count() > 0
    hours = boosting.boosted_per_hour(train, test, ["x1"], hours=(3, 4), min_rows=10**6, **opts)
    assert hours.where("GBM_per_hour <> 0").count() == 0
    one = boosting.boosted_per_hour(train, test, ["x1"], hours=(12,), min_rows=30, rounds=1, depth=2)
    assert one.where("GBM_per_hour > 0").count() == one.count() > 0
    holes = lambda df: df.withColumn("x1", F.when(F.col("slot") % 5 != 0, F.col("x1"))).withColumn("x2", F.when(F.col("slot") % 7 != 0, F.col("x2")).otherwise(F.lit(float("nan"))))
    gaps = boosting.boosted(holes(train), holes(test), ["x1", "x2"], **opts)
    assert gaps.count() == test.count() and gaps.where("GBM is null").count() == 0  # every row gets a forecast
    assert gaps.columns == [*test.columns, "GBM"]
    model = boosting.fit_boosting(train, ["x1", "x2"], **opts)
    noise = test.withColumn("x2", F.col("x2"))
    imp = {r["feature"]: r["importance"] for r in boosting.permutation_importance(model, noise, ["x1", "x2"], ["series_id", "slot"], repeats=1).collect()}
    assert imp["x1"] > imp["x2"]


def test_missing_arms_report_each_arm(assigned):
    out = grids.missing_arms(assigned, ["x1", "x2"])
    assert {r["arm"] for r in out.collect()} == {"left_out", "weighted"}
    assert out.where("n < 8 or rmse is null").count() == 0
