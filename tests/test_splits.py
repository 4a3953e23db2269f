import math
from datetime import date, timedelta

import pytest
from conftest import hourly_panel
from pyspark.sql import functions as F

from panelcast.operators import splits
from panelcast.operators.grid import day_facts


@pytest.fixture(scope="module")
def days(spark):
    data = [(s, date(2025, 1, 1) + timedelta(days=i), 24, 0 if s == "b" and i % 10 == 3 else 24) for s, n in (("a", 61), ("b", 53)) for i in range(n)]
    return spark.createDataFrame(data, "series_id string, day date, n_slots bigint, n_obs bigint").repartition(3)


def by_fold(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["series_id"], r["fold"]), {}).setdefault(r["role"], []).append(r["day"])
    return out


def test_rolling_origin_blocks(days):
    got = by_fold(splits.rolling_origin(days, 4, 20, 100))
    tests = [sorted(got["a", f"T{k}"]["test"]) for k in (1, 2, 3, 4)]
    assert [len(t) for t in tests] == [10, 10, 10, 11]
    for k in (1, 2, 3, 4):
        fold = got["a", f"T{k}"]
        used = sorted(fold["train"] + fold["val"])
        assert max(used) < min(fold["test"]) and max(fold["train"]) < min(fold["val"])
        n = len(used)
        assert len(fold["val"]) == min(max(7, math.ceil(0.15 * n)), n - 1)
    assert all(d.day != 4 for d in got["b", "T1"]["train"] if d.month == 1)


def test_rolling_origin_skips_short_training(days):
    assert {f for s, f in by_fold(splits.rolling_origin(days, 4, 20, 24 * 25)) if s == "a"} == {"T2", "T3", "T4"}


def test_random_days_partition(days):
    got = by_fold(splits.random_days(days, 5, 3))
    for s, n in (("a", 61), ("b", 53)):
        tests = [d for k in range(1, 6) for d in got[s, f"K{k}"]["test"]]
        assert len(tests) == len(set(tests)) == n
        assert [len(got[s, f"K{k}"]["test"]) for k in range(1, 5)] == [n // 5] * 4
        for k in range(1, 6):
            f = got[s, f"K{k}"]
            assert not set(f["test"]) & set(f["train"] + f["val"]) and not set(f["train"]) & set(f["val"])
            assert len(f["val"]) == 7
    again = by_fold(splits.random_days(days.repartition(11), 5, 3))
    assert {k: {r: sorted(v) for r, v in f.items()} for k, f in got.items()} == {k: {r: sorted(v) for r, v in f.items()} for k, f in again.items()}
    other = by_fold(splits.random_days(days, 5, 4))
    assert sorted(other["a", "K1"]["test"]) != sorted(got["a", "K1"]["test"])


def test_fold_sums_equal_row_copies(spark):
    panel = hourly_panel(spark, {"a": [float(i % 17) for i in range(24 * 40)], "b": [None if i % 5 == 0 else 1.0 * i for i in range(24 * 40)]})
    folds = splits.both_protocols(day_facts(panel), {"n_folds": 3, "first_test_days": 15, "min_train_rows": 10}, {"n_folds": 4})
    a = splits.assign(panel, folds)
    assert a.count() == panel.count()
    fast = splits.fold_sums(a, {"s": F.col("y"), "n": F.lit(1)}, {"h": F.hour("ts")})
    slow = splits.train_rows(a).groupBy("series_id", "protocol", "fold", F.hour("ts").alias("h")).agg(F.sum("y").alias("s"), F.count("*").alias("n"))
    key = ["series_id", "protocol", "fold", "h"]
    assert fast.select(*key, "s", "n").orderBy(*key).collect() == slow.select(*key, "s", "n").orderBy(*key).collect()


def test_hidden_days(spark):
    panel = hourly_panel(spark, {"a": [99.0 if i // 24 == 7 else 1.0 for i in range(240)]})
    folds = spark.createDataFrame([("a", "p", "K1", date(2025, 6, 1) + timedelta(days=i), "test" if i == 7 else "train") for i in range(10)], "series_id string, protocol string, fold string, day date, role string")
    out = splits.hide_history(panel, folds)
    assert out.agg(F.max("history_y")).first()[0] == 1.0
    assert out.where("not history_available").count() == 24


def test_walk_forward(days):
    got = splits.walk_forward(days, 20, 7, 24 * 25).where("series_id = 'a'").orderBy("day").collect()
    assert got[0]["origin"] == date(2025, 1, 1) + timedelta(days=27)
    assert all(r["origin"] <= r["day"] < r["origin"] + timedelta(days=7) for r in got)
    assert all(r["n_train"] == 24 * (r["origin"] - date(2025, 1, 1)).days for r in got)


def test_time_splits(spark):
    panel = hourly_panel(spark, {"a": [1.0] * 2000, "b": [1.0] * 500})
    count = lambda df: {(r["series_id"], r["role"]): r["count"] for r in df.groupBy("series_id", "role").count().collect()}
    assert count(splits.time_split(panel, "tail_share", 0.15, 168)) == {("a", "train"): 1700, ("a", "val"): 300, ("b", "train"): 332, ("b", "val"): 168}
    assert count(splits.time_split(panel, "head_share", 0.7))["a", "train"] == 1400
    share = count(splits.time_split(panel, "random_rows", 0.1))["a", "val"] / 2000
    assert 0.07 < share < 0.13
    with pytest.raises(ValueError):
        splits.time_split(panel, "other", 1)


def test_shares_are_decimal(spark):
    # in binary 0.7 of 90 is a hair less than 63
    panel = hourly_panel(spark, {"a": [1.0] * 90, "b": [1.0] * 91})
    got = splits.time_split(panel, "head_share", 0.7).where("role = 'train'").groupBy("series_id").count().collect()
    assert {r["series_id"]: r["count"] for r in got} == {"a": 63, "b": 63}
    tail = splits.time_split(panel, "tail_share", 0.7).where("role = 'val'").groupBy("series_id").count().collect()
    assert {r["series_id"]: r["count"] for r in tail} == {"a": 63, "b": 63}


def test_folds_are_read_from_storage(spark):
    # sorts of a task add up, so folds are not computed in the stage that joins them
    from panelcast.plans.backtest import scored_frame
    from panelcast.plans.datasets import H

    panel = hourly_panel(spark, {"a": [float(i % 24) for i in range(24 * 30)]}).withColumn("driver", F.lit(1.0)).withColumn("capacity", F.lit(23.0))
    folds = scored_frame(panel, H.setup)[1]
    plan = folds._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    days = day_facts(panel)
    assert folds.exceptAll(splits.both_protocols(days, H.setup.rolling, H.setup.random)).count() == 0
    assert folds.count() == splits.both_protocols(days, H.setup.rolling, H.setup.random).count()
