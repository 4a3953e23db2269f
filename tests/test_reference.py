import math
from datetime import datetime

import pytest
from conftest import START_SLOT, hourly_panel
from pyspark.sql import functions as F

from panelcast.functions.time import HOURLY
from panelcast.operators import joins, reference, splits


def diurnal(n=96, scale=1000.0):
    return [max(math.sin((h % 24 - 6) / 12 * math.pi), 0.0) * scale for h in range(n)]


def blank(ys, lo, hi):
    return [None if lo <= i < hi else y for i, y in enumerate(ys)]


def frame(spark, series, start=datetime(2025, 6, 1)):
    n = max(len(v) for v in series.values())
    poa = {"driver double": diurnal(n, 900.0)}
    return hourly_panel(spark, series, start, poa)


def assigned(df, train, test):
    """Rows with fold memberships given by slot ranges of one fold."""
    inside = lambda r: (F.col("slot") >= START_SLOT + r[0]) & (F.col("slot") < START_SLOT + r[1])
    fold = F.struct(F.lit("p").alias("protocol"), F.lit("T1").alias("fold"))
    ev = F.struct(F.lit("p").alias("protocol"), F.lit("T1").alias("fold"), F.lit("test").alias("role"))
    return df.withColumns(
        {"train_of": F.when(inside(train), F.array(fold)).otherwise(F.array().cast("array<struct<protocol:string,fold:string>>")),
         "eval_of": F.when(inside(test), F.array(ev)).otherwise(F.array().cast("array<struct<protocol:string,fold:string,role:string>>"))}
    )


def predict(spark, series, train, test, capacity=1600.0, missing="null"):
    df = reference.with_lookback(frame(spark, series), HOURLY, "driver", missing=missing)
    a = assigned(df, train, test)
    caps = a.select("series_id").distinct().select("series_id", F.lit("p").alias("protocol"), F.lit("T1").alias("fold"), F.lit(capacity).alias("capacity"))
    learnt = (
        caps.withColumnRenamed("capacity", "capacity_fold")
        .join(reference.climatology_profile(a, HOURLY), list(reference.FOLD), "left")
        .join(reference.ratio_profile(a, caps, HOURLY, "driver"), list(reference.FOLD), "left")
    )
    rows = splits.eval_rows(a).join(learnt, list(reference.FOLD))
    cols = reference.reference_columns(HOURLY, "driver")
    out = rows.select("series_id", "slot", "driver", *[c.alias(n) for n, c in cols.items()]).orderBy("series_id", "slot").collect()
    return {s: [r for r in out if r["series_id"] == s] for s in series}


OTHER = [5.0] * 96


def test_persistence_uses_the_value_a_day_earlier(spark):
    out = predict(spark, {"a": diurnal(), "b": OTHER}, (0, 48), (48, 72))
    assert [r["Persistence"] for r in out["a"]] == pytest.approx(diurnal()[24:48])
    assert [r["Persistence"] for r in out["b"]] == [5.0] * 24


def test_persistence_skips_a_missing_day(spark):
    ys = [y + i // 24 for i, y in enumerate(diurnal())]
    out = predict(spark, {"a": blank(ys, 24, 48), "b": OTHER}, (0, 48), (48, 72))
    assert [r["Persistence"] for r in out["a"]] == pytest.approx(ys[0:24])


def test_zero_filled_mode_takes_the_filled_zero(spark):
    out = predict(spark, {"a": blank(diurnal(), 24, 48), "b": OTHER}, (0, 48), (48, 72), missing="zero")
    assert [r["Persistence"] for r in out["a"]] == [0.0] * 24


def test_persistence_falls_back_to_climatology(spark):
    out = predict(spark, {"a": diurnal(), "b": OTHER}, (0, 48), (0, 24))
    assert [r["Persistence"] for r in out["a"]] == pytest.approx([r["Climatology"] for r in out["a"]])
    assert [r["Climatology"] for r in out["a"]] == pytest.approx(diurnal()[:24])


def test_unseen_month_falls_back_to_the_hour(spark):
    panel = hourly_panel(spark, {"a": [None] * 24}, datetime(2025, 11, 1), {"driver double": [0.0] * 24})
    both = frame(spark, {"a": diurnal(48)}).unionByName(panel)
    a = assigned(both, (0, 48), (153 * 24, 154 * 24))
    profile = reference.climatology_profile(a, HOURLY)
    got = splits.eval_rows(a).join(profile, list(reference.FOLD)).withColumn("v", reference.climatology_value(F.month("ts"), F.hour("ts"))).orderBy("slot").collect()
    assert [r["v"] for r in got] == pytest.approx(diurnal()[:24])


def test_smart_persistence_depends_on_the_bounded_capacity(spark):
    low = predict(spark, {"a": diurnal(), "b": OTHER}, (0, 48), (48, 72), 500.0)["a"]
    high = predict(spark, {"a": diurnal(), "b": OTHER}, (0, 48), (48, 72), 1600.0)["a"]
    assert [r["SmartPersistence"] for r in low] != pytest.approx([r["SmartPersistence"] for r in high])


def test_no_zero_forecast_where_the_driver_is_high(spark):
    out = predict(spark, {"a": blank(diurnal(), 24, 72), "b": OTHER}, (0, 24), (72, 96))["a"]
    assert all(r["SmartPersistence"] > 0 and r["Persistence"] > 0 for r in out if r["driver"] > 50)


def test_lookback_stops_after_seven_days(spark):
    panel = hourly_panel(spark, {"a": [1.0] * 24 + [None] * 24 * 8, "b": [2.0] * 24 * 9})
    got = joins.lookback(panel, {"p": F.col("y")}, HOURLY).orderBy("series_id", "slot").collect()
    a = [r["p"] for r in got if r["series_id"] == "a"]
    assert a[:24] == [None] * 24 and a[24 : 24 * 8] == [1.0] * 24 * 7 and a[24 * 8 :] == [None] * 24


def test_convex_mix_recovers_the_better_reference(spark):
    data = [("s", "p", f"T{f}", float(i), float(i), float(i) + 10.0) for f in (1, 2, 3) for i in range(20)]
    df = spark.createDataFrame(data, "series_id string, protocol string, fold string, y double, a double, b double")
    assert {r["weight"] for r in reference.convex_mix(df, "a", "b").collect()} == {1.0}
    one = reference.convex_mix(df.where("fold = 'T1'"), "a", "b").first()
    assert one["weight"] == 0.5
