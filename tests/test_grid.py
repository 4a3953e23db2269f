import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from conftest import START, START_SLOT, hourly_panel, rows
from pyspark.sql import functions as F

from panelcast.functions.chunks import fill_both_ways, nearest, row_ranks, runs
from panelcast.functions.quantiles import exact_quantiles
from panelcast.functions.time import HOURLY
from panelcast.operators import grid, joins, quality
from panelcast.sources import exogenous, measurements, results


def sparse(seed, n=400, keep=0.3):
    rnd = random.Random(seed)
    return {i: round(rnd.uniform(-5, 50), 2) for i in range(n) if rnd.random() < keep or i in (0, n - 1)}


@pytest.fixture(scope="module")
def readings(spark):
    data = [(s, START_SLOT + i, y) for s in ("a", "b") for i, y in sparse(s).items()]
    return spark.createDataFrame(data, "series_id string, slot bigint, y double").repartition(5)


@pytest.mark.parametrize("width", [3, 7, 64, 8192])
def test_grid_is_complete_whatever_the_chunk_width(readings, width):
    got = rows(grid.regular_grid(readings, HOURLY, width=width, bounds=True).select("series_id", "slot", "y", "first_slot", "last_slot"), "series_id", "slot")
    want = [
        (s, START_SLOT + i, sparse(s).get(i), START_SLOT, START_SLOT + 399) for s in ("a", "b") for i in range(400)
    ]
    assert got == want


def test_single_reading_and_long_gap(spark):
    data = [("one", 100, 1.0), ("gap", 5, 1.0), ("gap", 50005, 2.0)]
    df = grid.regular_grid(spark.createDataFrame(data, "series_id string, slot bigint, y double"), HOURLY, width=512)
    got = {r["series_id"]: (r["n"], r["obs"]) for r in df.groupBy("series_id").agg(F.count("*").alias("n"), F.count("y").alias("obs")).collect()}
    assert got == {"one": (1, 1), "gap": (50001, 2)}


def test_missing_flag_fill_and_clip(spark):
    df = grid.regular_grid(spark.createDataFrame([("a", 0, -3.0), ("a", 2, 4.0)], "series_id string, slot bigint, y double"), HOURLY)
    assert rows(df.select("slot", "y", "y_filled", "is_missing"), "slot") == [(0, -3.0, 0.0, False), (1, None, 0.0, True), (2, 4.0, 4.0, False)]


@pytest.mark.parametrize("width", [2, 5, 1000])
def test_fill_and_carry_do_not_depend_on_width(spark, width):
    ys = [None, None, 1.0, None, None, None, None, 2.0, None, None, None, 3.0, None]
    panel = hourly_panel(spark, {"a": ys, "b": [None, 9.0] + [None] * 11})
    out = rows(fill_both_ways(panel, ["series_id"], ["y"], width).select("series_id", "slot", "y"), "series_id", "slot")
    assert [r[2] for r in out] == [1.0] * 3 + [1.0] * 4 + [2.0] * 4 + [3.0] * 2 + [9.0] * 13
    near = nearest(panel, ["series_id"], ["y"], width).select("series_id", "slot", "_ff_y", "_bf_y")
    got = rows(near, "series_id", "slot")[:13]
    assert [r[3] and r[3]["v"] for r in got] == [1.0] * 3 + [2.0] * 5 + [3.0] * 4 + [None]
    assert [r[3] and r[3]["slot"] - START_SLOT for r in got] == [2] * 3 + [7] * 5 + [11] * 4 + [None]
    assert [r[2] and r[2]["v"] for r in got] == [None] * 2 + [1.0] * 5 + [2.0] * 4 + [3.0] * 2
    assert [r[2] and r[2]["slot"] - START_SLOT for r in got] == [None] * 2 + [2] * 5 + [7] * 4 + [11] * 2


@pytest.mark.parametrize("width", [3, 8, 8192])
def test_runs_do_not_depend_on_width(spark, width):
    rnd = random.Random(4)
    ys = {s: [None if rnd.random() < 0.6 else 1.0 for _ in range(120)] for s in ("a", "b")}
    panel = hourly_panel(spark, ys).repartition(4)
    got = rows(runs(panel, ["series_id"], F.col("is_missing"), F.col("is_missing"), width).select("series_id", "start_slot", "n_slots"), "series_id", "start_slot")
    want = []
    for s in ("a", "b"):
        i = 0
        while i < 120:
            if ys[s][i] is None:
                j = i
                while j < 120 and ys[s][j] is None:
                    j += 1
                want.append((s, START_SLOT + i, j - i))
                i = j
            else:
                i += 1
    assert got == want


def test_published_gap_summary(spark):
    """Nine published gap lengths and the figures derived from them."""
    hours = [381, 175, 159, 83, 57, 10, 1, 1, 1]
    ys = [1.0]
    for h in hours:
        ys += [None] * h + [1.0]
    found = quality.missing_runs(hourly_panel(spark, {"a": ys}), HOURLY)
    s = quality.run_summary(found).first()
    assert sum(r["hours"] for r in found.collect()) == 868
    assert (s["longest_run"], s["n_runs"], s["n_single"], s["n_mid"], s["n_long"]) == (381, 9, 3, 6, 4)
    assert (s["median_run"], s["median_long_run"]) == (57.0, 167.0)
    assert s["pct_in_long"] == pytest.approx(91.935, abs=5e-4)


def test_flatline_runs(spark):
    panel = hourly_panel(spark, {"a": [0.0] * 6 + [2.0] * 4 + [2.5] * 3 + [None] + [2.5] * 4})
    assert rows(quality.flatlines(panel, HOURLY).select("value", "hours"), "value") == [(2.0, 4), (2.5, 4)]


@pytest.mark.parametrize("width", [4, 8192])
def test_row_ranks(spark, width):
    panel = hourly_panel(spark, {"a": [1.0] * 10, "b": [1.0] * 3}).where("slot % 3 <> 0")
    got = rows(row_ranks(panel, ["series_id"], width=width).select("series_id", "slot", "rank", "n_rows"), "series_id", "slot")
    for s in ("a", "b"):
        mine = [r for r in got if r[0] == s]
        assert [r[2] for r in mine] == list(range(1, len(mine) + 1))
        assert {r[3] for r in mine} == {len(mine)}


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    data = {"skew": np.r_[np.zeros(500), rng.gamma(1.0, 50.0, 501)], "neg": rng.normal(0, 3, 777), "one": np.array([4.2])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double").repartition(6)
    probs = [0.0, 0.05, 0.5, 0.999, 1.0]
    for r in exact_quantiles(df, ["k"], "v", probs).collect():
        assert r["value"] == pytest.approx(np.quantile(data[r["k"]], r["prob"]), rel=1e-12, abs=1e-12)
    assert exact_quantiles(df, ["k"], "v", probs).count() == 15


def test_drivers_filled_on_their_own_table_equal_the_per_series_fill(spark):
    vals = spark.createDataFrame([("a", 10, 1.0), ("a", 40, 1.0), ("b", 0, 1.0), ("b", 60, 1.0), ("c", 70, 1.0), ("c", 75, 1.0)], "series_id string, slot bigint, y double")
    exog = spark.createDataFrame([(5, 1.5, None), (8, None, 2.5), (20, 3.5, None), (21, None, None), (50, 4.5, 5.5)], "slot bigint, p double, q double")
    fast = joins.with_drivers(grid.regular_grid(vals, HOURLY, bounds=True), exog, ["p", "q"])
    slow = joins.with_drivers(grid.regular_grid(vals, HOURLY), exog, ["p", "q"])
    cols = ["series_id", "slot", "p", "q"]
    assert rows(fast.select(*cols), "series_id", "slot") == rows(slow.select(*cols), "series_id", "slot")


def test_complete_days_and_gap_days(spark):
    panel = hourly_panel(spark, {"a": [1.0] * 60, "b": [1.0] * 30 + [None] + [1.0] * 17})
    assert grid.complete_days(panel).groupBy("series_id").count().orderBy("series_id").collect() == [("a", 48), ("b", 48)]
    kept = grid.days_without_missing(grid.complete_days(panel))
    assert kept.groupBy("series_id").count().orderBy("series_id").collect() == [("a", 48), ("b", 24)]


def test_clock_change_and_missing_spring_hour(spark):
    start = datetime(2025, 3, 30)
    panel = hourly_panel(spark, {"a": [1.0, None] + [1.0] * 10, "b": [1.0] * 12}, start)
    changes = quality.clock_changes(panel, HOURLY, "Europe/London")
    assert {(r["series_id"], r["ts"]) for r in changes.collect()} == {(s, start + timedelta(hours=1)) for s in ("a", "b")}
    got = rows(quality.spring_forward(panel, HOURLY, "Europe/London"), "series_id")
    assert got == [("a", 1, 1, 1, True), ("b", 1, 0, 0, False)]


def test_long_csv(spark, tmp_path):
    (tmp_path / "s1.csv").write_text(
        "# exported\n _time,_field , _value\n2025-06-01T01:00:00Z,PPV,1\n2025-06-01T02:00:00Z,PPV,2\n2025-06-01T02:00:00Z,OTHER,7\n2025-06-01T03:00:00Z,PPV,oops\n"
    )
    got = measurements.read_long_csv(spark, str(tmp_path / "s1.csv"), "PPV")
    assert rows(got, "ts") == [
        ("s1.csv", START + timedelta(hours=1), 1.0),
        ("s1.csv", START + timedelta(hours=2), 2.0),
        ("s1.csv", START + timedelta(hours=3), None),
    ]
    moved = grid.relabel(grid.with_slot(got, HOURLY), -1)
    assert [r["slot"] for r in moved.orderBy("slot").collect()] == [START_SLOT, START_SLOT + 1, START_SLOT + 2]


def test_filter_reaches_the_parquet_scan(spark, tmp_path):
    spark.createDataFrame([("s", "2025-06-01 00:00:00", "PPV", "1", 3)], "sid string, _time string, _field string, _value string, other int").write.parquet(str(tmp_path / "m"))
    plan = measurements.read_long_parquet(spark, str(tmp_path / "m"), "PPV", "sid")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(_field,PPV)" in plan
    assert "other" not in plan.split("ReadSchema")[1]


def test_variable_sets(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "ts int, temperature_2m double, cloud_cover_low double, odd double")
    assert exogenous.project_variables(df, "full").columns == ["ts", "temperature_2m", "cloud_cover_low"]
    assert exogenous.project_variables(df, "forecast_matched").columns == ["ts", "temperature_2m"]
    with pytest.raises(ValueError):
        exogenous.project_variables(df, "nope")
    (tmp_path / "x.csv").write_text("time,temperature_2m_previous_day1\n2025-06-01T00:00,5.5\n2025-06-01T01:00,\n")
    catalogue = {"late": {"path": str(tmp_path / "x.csv"), "suffix": "_previous_day1"}}
    with pytest.warns(UserWarning):
        got = exogenous.load_product(spark, catalogue, "late")
    assert rows(got, "ts") == [(START, 5.5), (START + timedelta(hours=1), None)]
    with pytest.raises(ValueError):
        exogenous.load_product(spark, catalogue, "other")


def test_run_sink_replaces_only_its_own_partitions(spark, tmp_path):
    df = spark.createDataFrame([("p", 1)], "protocol string, v int")
    path = str(tmp_path / "r")
    results.write_run(df, path, "a", ("protocol",))
    results.write_run(df.withColumn("v", F.lit(2)), path, "b", ("protocol",))
    results.write_run(df.withColumn("v", F.lit(3)), path, "a", ("protocol",))
    assert results.read_run(spark, path, "a").first()["v"] == 3
    assert results.read_run(spark, path, "b").first()["v"] == 2
    assert results.tagged("metrics.csv", "noshift") == "metrics__noshift.csv"
    assert results.tagged("metrics.csv", None) == "metrics.csv"
