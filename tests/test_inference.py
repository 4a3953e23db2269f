import hashlib
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.functions.special import t_two_sided
from panelcast.operators import inference, value

SCHEMA = "series_id string, ts timestamp_ntz, y double, a double, b double"


def frame(spark, series):
    data = []
    for sid, (y, a, b, per_day) in series.items():
        for i, (u, v, w) in enumerate(zip(y, a, b)):
            ts = datetime(2025, 1, 1) + timedelta(days=i // per_day, hours=i % per_day)
            data.append((sid, ts, float(u), float(v), float(w)))
    return spark.createDataFrame(data, SCHEMA).repartition(4)


def test_dm_verdicts(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=400)
    near, far = y + rng.normal(0, 0.2, 400), y + rng.normal(0, 1.0, 400)
    eq1, eq2 = y + rng.normal(0, 0.5, 400), y + rng.normal(0, 0.5, 400)
    df = frame(spark, {"good": (y, near, far, 24), "tie": (y, eq1, eq2, 24), "same": (y, near, near, 24), "few": (y[:4], near[:4], far[:4], 24)})
    got = {r["series_id"]: r for r in inference.diebold_mariano(df, ["series_id"], "a", "b").collect()}
    assert got["good"]["better"] == "a" and got["good"]["p_value"] < 0.05 and got["good"]["statistic"] < 0
    assert got["tie"]["better"] == "no significant difference"
    assert got["same"]["better"] == "tie" and got["same"]["statistic"] is None
    assert got["few"]["better"] == "undetermined" and got["few"]["p_value"] is None
    d = (y - near) ** 2 - (y - far) ** 2
    assert got["good"]["statistic"] == pytest.approx(d.mean() / np.sqrt(d.var(ddof=1) / 400))
    with pytest.raises(ValueError):
        inference.loss_difference("a", "b", "cubed")


# Published (statistic, n, p) triples.
PUBLISHED_P = [
    (-1.6226410917267409, 3869, 0.10474764453967912),
    (0.7986990429530417, 3869, 0.4245139787971438),
    (0.11704666524458338, 2517, 0.9068324161078015),
    (1.9769584935543927, 2517, 0.04815533695992424),
    (8.151296364588191, 3869, 4.814467323384771e-16),
    (4.283312487659172, 2517, 1.910428576381597e-05),
    (-7.949393201818854, 2517, 2.8033313882766263e-15),
    (0.1816858252460609, 3869, 0.8558388106352827),
]


def test_student_tail_matches_published_values():
    t, n, p = (np.array(x, float) for x in zip(*PUBLISHED_P))
    assert t_two_sided(t, n - 1) == pytest.approx(p, rel=1e-10)
    assert t_two_sided(np.array([0.0, np.nan]), np.array([5.0, 5.0]))[0] == 1.0
    # closed form for one degree of freedom
    assert t_two_sided(np.array([1.0, 3.0]), np.array([1.0, 1.0])) == pytest.approx([0.5, 1 - 2 / np.pi * np.arctan(3.0)])


def brute_bootstrap(y, a, b, per_day, n_boot, width, seed=0):
    la, lb = (y - a) ** 2, (y - b) ** 2
    day = np.arange(len(y)) // per_day
    n_days = day.max() + 1
    sums = [np.bincount(day, weights=w) for w in (la, lb, np.ones(len(y)))]
    m = -(-n_days // width)
    blocks = [np.array([s[i * width : (i + 1) * width].sum() for i in range(m)]) for s in sums]
    gains, diffs = [], []
    for rep in range(n_boot):
        pick = [int(hashlib.md5(f"{seed}|{rep}|{j}".encode()).hexdigest()[:8], 16) % m for j in range(m)]
        sa, sb, n = (x[pick].sum() for x in blocks)
        gains.append((1 - np.sqrt(sa / n) / np.sqrt(sb / n)) * 100)
        diffs.append(sa - sb)
    tail = min(np.mean(np.array(diffs) >= 0), np.mean(np.array(diffs) <= 0))
    lo, hi = np.percentile(gains, [2.5, 97.5])
    return lo, hi, min(max(2 * tail, 1 / n_boot), 1.0), (np.sqrt(lb.sum()) - np.sqrt(la.sum())) / np.sqrt(lb.sum()) * 100


@pytest.mark.parametrize("width", [1, 3, 7])
def test_bootstrap_equals_brute_force(spark, width):
    rng = np.random.default_rng(5)
    n = 50 * 12
    shock = np.repeat(rng.normal(0, 1, 50), 12)
    y = rng.normal(size=n)
    a, b = y + 0.2 * shock + rng.normal(0, 0.2, n), y + 0.2 * shock + rng.normal(0, 0.3, n)
    df = frame(spark, {"x": (y, a, b, 12), "swap": (y, b, a, 12), "short": (y[:60], a[:60], b[:60], 12)})
    out = inference.block_bootstrap(inference.day_losses(df, ["series_id"], "a", "b"), ["series_id"], 300, 0, (width,), lanes=7)
    got = {r["series_id"]: r for r in out.collect()}
    lo, hi, p, seen = brute_bootstrap(y, a, b, 12, 300, width)
    assert (got["x"]["ci_low_pct"], got["x"]["ci_high_pct"], got["x"]["p_value"], got["x"]["rel_rmse_gain_pct"]) == pytest.approx((lo, hi, p, seen), rel=1e-9)
    assert got["swap"]["rel_rmse_gain_pct"] < 0 and got["x"]["n_days"] == 50
    assert got["short"]["n_days"] == 5 and got["short"]["ci_low_pct"] is None and got["short"]["rel_rmse_gain_pct"] is None


def test_bootstrap_separates_only_real_differences(spark):
    rng = np.random.default_rng(2)
    n = 120 * 12
    y, shock = rng.normal(size=n), np.repeat(rng.normal(0, 0.5, 120), 12)
    good, bad = y + shock * 0.1 + rng.normal(0, 0.2, n), y + shock * 0.1 + rng.normal(0, 0.8, n)
    e1, e2 = y + rng.normal(0, 0.5, n), y + rng.normal(0, 0.5, n)
    df = frame(spark, {"real": (y, good, bad, 12), "none": (y, e1, e2, 12), "same": (y, good, good, 12)})
    got = {r["series_id"]: r for r in inference.block_bootstrap(inference.day_losses(df, ["series_id"], "a", "b"), ["series_id"], 500).collect()}
    assert got["real"]["ci_low_pct"] > 0 and got["real"]["p_value"] < 0.01
    assert got["none"]["ci_low_pct"] < 0 < got["none"]["ci_high_pct"]
    assert got["same"]["rel_rmse_gain_pct"] == 0.0 and 0 <= got["same"]["p_value"] <= 1


def test_commitment_cost_and_tuning(spark):
    data = [("s", f"T{f}", 10.0 + i % 3, 2 * (10.0 + i % 3), False) for f in (1, 2) for i in range(30)]
    data += [("neg", f"T{f}", 4.0, -3.0, False) for f in (1, 2) for _ in range(5)]
    df = spark.createDataFrame(data, "series_id string, fold string, y double, yhat double, is_missing boolean")
    cost = {(r["series_id"], r["ratio"]): r["cost"] for r in value.commitment_cost(df, ["series_id"]).collect()}
    assert cost["s", 1.0] == pytest.approx(1.0) and cost["s", 5.0] == pytest.approx(5.0)
    assert cost["neg", 3.0] == pytest.approx(1.0)
    tuned = {(r["series_id"], r["ratio"]): r for r in value.tuned_cost(df, ["series_id"]).collect()}
    assert tuned["s", 2.0]["mean_scale"] == pytest.approx(0.5) and tuned["s", 2.0]["tuned_cost"] == pytest.approx(0.0, abs=1e-12)
    assert tuned["neg", 2.0]["mean_scale"] == pytest.approx(0.2)


def test_unfinished_pairs_are_left_out(spark):
    rows = [("a", datetime(2025, 6, 1 + i), 10.0 * i, 10.0 * i + 1, 10.0 * i + 2) for i in range(10)]
    rows += [("a", datetime(2025, 6, 1), 5.0, x, 1.0) for x in (float("inf"), float("nan"))]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, y double, p double, q double")
    r = inference.dm_statistic(df.withColumn("q", F.col("q") + F.col("y") / 100), ["series_id"], "p", "q").first()
    assert r["n"] == 10 and r["mean_diff"] < 0
    assert inference.day_losses(df, ["series_id"], "p", "q").agg(F.sum("n"), F.sum("la")).first() == (10, 10.0)
