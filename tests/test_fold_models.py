"""Boosted trees against plain searches, and the rules of the per-fold models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions import trees
from panelcast.functions.trees import Boosting
from panelcast.operators import fold_models, splits
from panelcast.plans import backtest
from test_models import assigned  # noqa: F401  the fixture

QUICK = Boosting(rounds=8, rate=0.3, depth=3, min_leaf=5, patience=3)


def plain_split(x, residual, o):
    """Best gain over every feature, every cut between two values, missing on either side."""
    best, n, s = 0.0, len(x), residual.sum()
    for f in range(x.shape[1]):
        known = np.isfinite(x[:, f])
        for cut in np.unique(x[known, f]):
            for left_missing in (False, True):
                left = (known & (x[:, f] <= cut)) | (~known & left_missing)
                k = left.sum()
                if min(k, n - k) < o.min_leaf:
                    continue
                a = residual[left].sum()
                best = max(best, a * a / (k + o.penalty) + (s - a) ** 2 / (n - k + o.penalty) - s * s / (n + o.penalty))
    return best


@pytest.mark.parametrize("seed", range(15))
def test_best_split_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(10, 120))
    x = rng.integers(0, 9, (n, 3)).astype(float)
    x[rng.random(x.shape) < 0.2] = np.nan
    residual = rng.normal(size=n) + np.where(np.isnan(x[:, 1]), 1.0, 0.0)
    o = Boosting(min_leaf=int(rng.integers(1, 8)))
    binned = trees.Binned(x, np.ones(n, bool), o.bins)
    found = trees.best_split(binned.histogram(np.arange(n), residual), o)
    want = plain_split(x, residual, o)
    assert (found[0] if found else 0.0) == pytest.approx(want, abs=1e-9)


def test_trees_respect_leaves_depth_and_size():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = x[:, 0] * 3 + np.sin(x[:, 1] * 3)
    rows = np.arange(600)
    for o in (Boosting(leaves=7, rate=1.0, penalty=0.0), Boosting(depth=2, rate=1.0, min_leaf=5, penalty=0.0)):
        step = np.zeros(600)
        assert trees.grow(trees.Binned(x, np.ones(600, bool), 255), rows, y, rows, step, o)
        values, counts = np.unique(step, return_counts=True)
        assert len(values) <= min(o.leaves, 2**o.depth) and counts.min() >= o.min_leaf
        for v in values:
            assert v == pytest.approx(y[step == v].mean())


def test_boosting_stops_early_and_never_reads_what_it_forecasts():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 3))
    y = 50 * (x[:, 0] > 0) + rng.normal(0, 10, 900)
    train, held = np.arange(900) < 700, rng.random(900) < 0.15
    full = trees.boost(x, y, train, held, Boosting())
    assert ((y - full)[~train] ** 2).mean() < 0.25 * y[~train].var()
    hidden = np.where(train, y, np.nan)
    assert (trees.boost(x, hidden, train, held, Boosting()) == full).all()
    long = trees.boost(x, y, train, np.zeros(900, bool), Boosting(rounds=300))
    assert ((y - long)[train] ** 2).mean() < ((y - full)[train] ** 2).mean()  # without a stop it goes on
    assert (trees.boost(x, y, ~train & False, held, QUICK) == 0).all()
    assert trees.boost(x, y, train, train, QUICK).std() > 0  # all rows held out: fit on them


def test_many_values_share_bins():
    x = np.arange(5000.0)[:, None]
    assert len(trees.edges(x[:, 0], 255)) == 254
    binned = trees.Binned(np.vstack([x, [[np.nan]], [[1e9]]]), np.ones(5002, bool), 255)
    assert binned.codes[5000, 0] == binned.width - 1 > binned.codes[5001, 0] == binned.codes[:5000].max()


@pytest.fixture(scope="module")
def caps(assigned):  # noqa: F811
    return splits.fold_capacity(assigned, assigned.groupBy("series_id").agg(F.max("capacity").alias("capacity")))


def rules(**change):
    return fold_models.Rules(plain=QUICK, ratio=QUICK, hour=Boosting(rounds=5, rate=0.3, depth=2, min_leaf=3), **change)


def test_every_row_to_forecast_comes_out_once(spark, assigned, caps):  # noqa: F811
    rows = assigned.withColumns({"x1": F.when(F.col("slot") % 5 != 0, F.col("x1")), "x2": F.when(F.col("slot") % 7 != 0, F.col("x2")).otherwise(F.lit(float("nan")))})
    out = fold_models.forecasts(rows, caps, ["x1", "x2"], "x1", rules()).cache()
    keys = [*fold_models.FOLD, "role", "slot"]
    asked = splits.eval_rows(assigned).select(*keys)
    assert out.count() == out.select(*keys).distinct().count() == asked.count()
    assert out.select(*keys).exceptAll(asked).count() == 0
    assert out.where("GBM is null or GBM_kt is null or GBM_per_hour is null or least(GBM, GBM_kt, GBM_per_hour) < 0").count() == 0
    again = fold_models.forecasts(rows.repartition(3, "day"), caps, ["x1", "x2"], "x1", rules())
    assert out.exceptAll(again).count() == 0  # the layout of the input does not matter


def test_rules_of_ratio_and_hours(spark, assigned, caps):  # noqa: F811
    asked = splits.eval_rows(assigned).select(*fold_models.FOLD, "role", "slot", "x1", "ts")
    keys = [*fold_models.FOLD, "role", "slot"]
    out = fold_models.forecasts(assigned, caps, ["x1", "x2"], "x1", rules(least_ratio=50)).join(asked, keys)
    cap = caps.select(*fold_models.FOLD, F.col("capacity").alias("cap"))
    assert out.where("x1 < 50 and GBM_kt <> 0").count() == 0
    over = out.join(cap, list(fold_models.FOLD)).where("GBM_kt > 1.5 * greatest(cap * x1 / 1000, 1) + 1e-9")
    assert over.count() == 0
    few = fold_models.forecasts(assigned, caps, ["x1", "x2"], "x1", rules(least_ratio=10**6, least_hour=10**6))
    assert few.where("GBM_kt <> GBM or GBM_per_hour <> 0").count() == 0
    one = fold_models.forecasts(assigned, caps, ["x1"], "x1", rules(least_hour=10), members=["GBM_per_hour"])
    assert one.columns[-1] == "GBM_per_hour" and one.where("GBM_per_hour > 0").count() > 0


def test_boosted_members_learn_and_enter_the_fusions(spark, assigned, caps):  # noqa: F811
    out = fold_models.forecasts(assigned, caps, ["x1", "x2"], "x1", rules())
    truth = splits.eval_rows(assigned).select(*fold_models.FOLD, "role", "slot", "y", "ts", "active", "is_missing")
    wide = truth.join(out, [*fold_models.FOLD, "role", "slot"])
    sse, sst = wide.where("role = 'test' and not is_missing").agg(F.sum(F.pow(F.col("y") - F.col("GBM"), 2)), F.var_pop("y") * F.count("*")).first()
    assert sse < 0.5 * sst
    fused = backtest.fuse(wide, list(fold_models.MEMBERS))
    assert fused.count() == wide.where("role = 'test'").count()
    assert fused.where("abs(Mean - (GBM + GBM_kt + GBM_per_hour) / 3) > 1e-9").count() == 0


def test_importance_ranks_the_features(spark, assigned, caps):  # noqa: F811
    rows = assigned.withColumn("noise", F.rand(3))
    imp = fold_models.importance(rows, caps, ["x1", "x2", "noise"], "x1", rules(), repeats=2)
    per = {r["feature"]: r["i"] for r in imp.groupBy("feature").agg(F.avg("importance").alias("i")).collect()}
    assert set(per) == {"x1", "x2", "noise"} and per["x1"] > 10 * abs(per["noise"])
    assert imp.count() == 3 * caps.count()
