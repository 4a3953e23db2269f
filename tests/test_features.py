import math
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from conftest import hourly_panel, rows
from pyspark.sql import functions as F

from panelcast.functions import columns as C
from panelcast.functions.time import DAILY, HOURLY, local_offset_slots
from panelcast.operators import align, features, joins, solar, splits
from panelcast.operators.reference import year_climatology


def test_lags_and_context_respect_series_and_holes(spark):
    panel = hourly_panel(spark, {"a": [1.0, 2.0, 3.0, None, 5.0], "b": [10.0, 20.0, 30.0, 40.0, 50.0]}).withColumn("x", F.col("y"))
    got = rows(features.temporal_context(panel, ["x", "gone"]).select("series_id", "slot", "x_lag1", "x_lead1", "x_roll3"), "series_id", "slot")
    assert [r[2:] for r in got[:5]] == [(None, 2.0, 1.5), (1.0, 3.0, 2.0), (2.0, None, 2.5), (3.0, 5.0, 4.0), (None, None, 5.0)]
    assert got[5][2] is None and got[9][3] is None
    lag = features.target_lags(panel.where("slot % 2 = 0"), (1, 2))
    assert lag.where("y_lag1 is not null").count() == 0


def test_label_free_mask_ignores_labels(spark):
    elev = [30.0 if 6 <= h % 24 <= 18 else -10.0 for h in range(48)]
    panel = hourly_panel(spark, {"a": [float(h) for h in range(48)]}, extra={"sun_elev double": elev})
    scaled = panel.withColumn("y", F.col("y") * 7.3)
    flags = [[r["active"] for r in features.active_by_elevation(p, 0, 0).orderBy("slot").collect()] for p in (panel, scaled)]
    assert flags[0] == flags[1] == [e > 5 for e in elev]


def test_ablation_rules(spark):
    df = hourly_panel(spark, {"a": [1.0]})
    names = ["temperature_2m", "sun_zenith", "clearness_kt_lag1", "poa_global", "cloud_cover_roll3", "temperature_2m"]
    out, kept = features.ablate(df, names, ["solar"])
    assert kept == ["temperature_2m", "cloud_cover_roll3", "hour_sin", "hour_cos"] and "hour_sin" in out.columns
    assert features.ablate(df, names, ["context"])[1] == ["temperature_2m", "sun_zenith", "poa_global"]
    assert features.feature_names(["doy_sin", "sun_elev", "t", "t_lag1"], ["t", "u"], ["t"]) == ["t", "sun_elev", "t_lag1", "doy_sin"]


@pytest.mark.parametrize("when,elevation", [(datetime(2025, 6, 21, 12), 90 - 50.91 + 23.44), (datetime(2025, 3, 20, 12), 90 - 50.91), (datetime(2025, 12, 21, 12), 90 - 50.91 - 23.44)])
def test_noon_elevation(spark, when, elevation):
    df = spark.createDataFrame([(when, 50.91, 0.0)], "ts timestamp_ntz, lat double, lon double")
    r = solar.sun_position(df).first()
    assert r["sun_elev"] == pytest.approx(elevation, abs=0.5) and r["sun_az"] == pytest.approx(180, abs=5)


def test_night_and_irradiance_parts(spark):
    df = spark.createDataFrame([(datetime(2025, 6, 21, h), 50.91, -1.4, 30.0, 180.0, 500.0, 300.0) for h in (0, 12)], "ts timestamp_ntz, lat double, lon double, tilt double, azimuth double, shortwave_radiation double, direct_normal_irradiance double")
    night, noon = solar.irradiance(solar.sun_position(df)).orderBy("ts").collect()
    assert night["airmass"] == 40.0 and night["ghi_toa_horiz"] == 0.0 and night["clearness_kt"] == 0.0
    assert 1.0 < noon["airmass"] < 1.3 and 1300 < noon["dni_extra"] < 1420
    sky = 500 - 300 * noon["cos_zenith"]
    want = 300 * noon["cos_aoi"] + sky * (1 + math.cos(math.radians(30))) / 2 + 500 * 0.25 * (1 - math.cos(math.radians(30))) / 2
    assert noon["poa_global"] == pytest.approx(want)
    assert spark.range(1).select(C.airmass(F.lit(0.0))).first()[0] == pytest.approx(1.0, abs=1e-3)


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.2, 0.21, 1.2, 1.3)], "x double")
    got = rows(df.select("x", C.labelled_bins(F.col("x"), [0, 0.2, 1.2], ["lo", "hi"]).alias("l"), C.equal_bins(F.col("x"), 0.0, 1.2, 6).alias("b")), "x")
    assert [r[1] for r in got] == [None, "lo", "lo", "hi", "hi", None]
    assert got[1][2] == 1 and got[4][2] == 6 and got[5][2] is None


def nine_days(spark):
    ys = [float(i) for i in range(216)]
    ys[8 * 24 + 12] = None
    panel = hourly_panel(spark, {"a": ys, "b": [1.0] * 216}, extra={"x double": [float(i) for i in range(216)]})
    return panel.withColumn("active", F.hour("ts").between(6, 18))


def test_supervised_window_weights(spark):
    out = features.supervised_windows(nine_days(spark), F.lit(100.0), ["x"]).orderBy("series_id", "day").collect()
    assert [(r["series_id"], r["day"]) for r in out] == [(s, date(2025, 6, d)) for s in ("a", "b") for d in (8, 9)]
    last = out[1]
    assert last["weight"][12] == 0 and last["evaluate"][12] == 0 and last["weight"][11] == 4 and last["weight"][2] == 1
    assert len(last["pv"]) == 8 and len(last["pv"][0]) == 24 and last["pv"][7] == [0.0] * 24
    assert last["pv"][6][3] == pytest.approx((7 * 24 + 3) / 100) and last["x"][7][3] == 8 * 24 + 3
    assert last["past"][7] == [0.0] * 24 and last["past"][0] == [1.0] * 24
    assert last["target"][3] == pytest.approx((8 * 24 + 3) / 100)
    naive = features.supervised_windows(nine_days(spark), F.lit(100.0), availability=False, weight_missing=True).orderBy("series_id", "day").collect()[1]
    assert naive["weight"][12] == 4 and "available" not in naive.asDict()


def test_hidden_days_do_not_appear_as_history(spark):
    ys = [99.0 if i // 24 == 7 else 1.0 for i in range(240)]
    panel = hourly_panel(spark, {"a": ys}).withColumn("active", F.lit(True))
    out = features.supervised_windows(panel, F.lit(1.0), hidden=F.col("ts").cast("date") == date(2025, 6, 8)).where("day = '2025-06-10'").first()
    pos = 5  # days 3..9 are history of day 10; day 8 is the sixth
    assert out["pv"][pos] == [0.0] * 24 and out["available"][pos] == [0.0] * 24
    assert max(max(d) for d in out["pv"]) == 1.0


def test_standardise_uses_training_rows_only(spark):
    panel = hourly_panel(spark, {"a": [1.0] * 480}, extra={"x double": [float(i % 7) if i < 240 else 1000.0 for i in range(480)]})
    folds = spark.createDataFrame([("a", "p", "T1", date(2025, 6, 1) + timedelta(days=i), "train" if i < 10 else "test") for i in range(20)], "series_id string, protocol string, fold string, day date, role string")
    stats = features.training_statistics(splits.assign(panel, folds), ["x"])
    x = np.arange(240) % 7
    r = stats.first()
    assert (r["x_mean"], r["x_sd"]) == pytest.approx((x.mean(), x.std()))
    z = features.standardise(panel, stats, ["x"], ["series_id"]).orderBy("slot").first()["x_z"]
    assert z == pytest.approx((0 - x.mean()) / (x.std() + 1e-6))


def daily(spark, n=800):
    rng = np.random.default_rng(0)
    start = date(2023, 1, 1)
    base = (start - date(1970, 1, 1)).days
    vals = [None if rng.random() < 0.05 else float(rng.gamma(2, 10)) for _ in range(n)]
    data = [("s", base + i, datetime(2023, 1, 1) + timedelta(days=i), v, v or 0.0, v is None) for i, v in enumerate(vals)]
    return spark.createDataFrame(data, "series_id string, slot bigint, ts timestamp_ntz, y double, y_filled double, is_missing boolean"), data


def circular(a, b):
    d = abs(a - b) % 366
    return min(d, 366 - d)


def test_envelope_and_year_climatology_brute_force(spark):
    panel, data = daily(spark)
    q = {}
    for s in range(7):
        for d in range(1, 367):
            v = [r[4] for r in data if r[1] % 7 == s and circular(r[2].timetuple().tm_yday, d) <= 14]
            q[s, d] = np.quantile(v, 0.95) if v else None
    got = {(r["season_slot"], r["doy"]): r["envelope"] for r in features.upper_envelope(panel, DAILY).collect()}
    assert len(got) == 7 * 366
    for (s, d), v in got.items():
        near = [q[s, e] for e in range(1, 367) if circular(e, d) <= 7 and q[s, e] is not None]
        assert v == pytest.approx(max(np.mean(near), 1.0))
    clim = {(r["season_slot"], r["doy"]): r["clim"] for r in year_climatology(panel, DAILY).collect()}
    for s, d in ((0, 1), (3, 366), (6, 180), (2, 200)):
        v = [r[3] for r in data if not r[5] and r[1] % 7 == s and circular(r[2].timetuple().tm_yday, d) <= 7]
        if v:
            assert clim[s, d] == pytest.approx(np.mean(v))
    assert None not in clim.values()


def test_planted_shift_is_recovered(spark):
    n = 24 * 60
    rng = np.random.default_rng(1)
    g = [max(math.sin((h % 24 - 6) / 12 * math.pi), 0) * 800 * rng.uniform(0.3, 1) for h in range(n)]
    late = [g[i - 2] if i >= 2 else 0.0 for i in range(n)]
    early = [g[i + 1] if i + 1 < n else 0.0 for i in range(n)]
    frame = hourly_panel(spark, {"late": late, "early": early}, extra={"driver double": g}).withColumns({"active": F.col("driver") > 20, "capacity": F.lit(1000.0)})
    best = {r["series_id"]: r["selected_shift"] for r in align.best_shift(align.shift_scan(frame), ["series_id"]).collect()}
    assert best == {"late": -2, "early": 1}
    lags = {r["series_id"]: r["peak_lag"] for r in align.peak_lag(frame).collect()}
    assert lags == {"late": 2, "early": -1}


def test_local_clock_record_is_recovered_by_the_offset_scan(spark):
    start, n = datetime(2025, 3, 20), 24 * 20
    rng = np.random.default_rng(2)
    g = [max(math.sin((h % 24 - 6) / 12 * math.pi), 0) * 800 * rng.uniform(0.3, 1) for h in range(n)]
    off = [1 if start + timedelta(hours=h) >= datetime(2025, 3, 30, 1) else 0 for h in range(n)]
    y = [None] * n
    for i in range(n):
        if i + off[i] < n:
            y[i + off[i]] = g[i]  # logged at local time, read as UTC
    frame = hourly_panel(spark, {"a": y}, start, {"driver double": g, "off double": [float(o) for o in off]}).withColumns({"active": F.col("driver") > 20, "capacity": F.lit(1000.0)})
    got = {r["extra"]: r["r2"] for r in align.offset_scan(frame, F.col("off")).collect()}
    assert max(got, key=got.get) == 0 and got[0] > 0.99


def test_two_zones_in_one_scan_with_a_doubled_and_a_missing_hour(spark):
    """Records of two sites, each in local time over both clock changes, on the hourly grid."""
    zones = {"a": "Europe/London", "b": "America/New_York"}
    start, n = datetime(2025, 3, 1), 24 * 260
    rng = np.random.default_rng(4)
    g = [max(math.sin((h % 24 - 6) / 12 * math.pi), 0) * 800 * rng.uniform(0.3, 1) for h in range(n)]
    series, offsets = {}, {}
    for s, zone in zones.items():
        off = [int((start + timedelta(hours=h)).replace(tzinfo=timezone.utc).astimezone(ZoneInfo(zone)).utcoffset().total_seconds() // 3600) for h in range(n)]
        y = [None] * n
        for i in range(n):
            if 0 <= i + off[i] < n:
                y[i + off[i]] = g[i]
        series[s], offsets[s] = y, off
    frame = hourly_panel(spark, series, start, {"driver double": g}).withColumns({"active": F.col("driver") > 20, "capacity": F.lit(1000.0)})
    zone = F.when(F.col("series_id") == "a", zones["a"]).otherwise(zones["b"])
    offset = local_offset_slots(F.col("ts"), zone, HOURLY)
    got = {(r["series_id"], r["hour"]): r["o"] for r in frame.select("series_id", F.col("slot").alias("hour"), offset.alias("o")).collect()}
    first = min(h for _, h in got)
    assert all(got[s, first + h] == offsets[s][h] for s in zones for h in range(n))
    scan = {}
    for r in align.offset_scan(frame, offset).collect():
        scan.setdefault(r["series_id"], {})[r["extra"]] = r["r2"]
    assert all(max(v, key=v.get) == 0 and v[0] > 0.99 for v in scan.values())
    # in autumn one local slot is met by two UTC slots, in spring one by none
    met = joins.moved_by_row(frame.select("series_id", "slot", "y"), frame.select("series_id", "slot", offset.alias("off")), F.col("off"), [0])
    times = met.groupBy("series_id", "slot").count()
    for s in zones:
        twice = [r["slot"] for r in times.where((F.col("series_id") == s) & (F.col("count") == 2)).collect()]
        seen = {r["slot"] for r in times.where(F.col("series_id") == s).collect()}
        skipped = [t for t in range(min(seen), max(seen)) if t not in seen]
        assert len(twice) == 1 and len(skipped) == 1
        back = [i for i in range(1, n) if offsets[s][i] < offsets[s][i - 1]][0]
        assert twice[0] == first + back + offsets[s][back]
    with pytest.raises(ValueError):
        local_offset_slots(F.col("ts"), "UTC", DAILY)


def test_published_shift_choice(spark):
    # R2 per shift -3..3 of three published blocks and the shift chosen.
    blocks = {
        "T1": ([0.3075946264596737, 0.5013836271083658, 0.4965992478993494, 0.253928414726013, -0.21704334683652138, -0.638757970656312, -0.9648313768053154], -2),
        "T2": ([0.38206484785312067, 0.5721024400283259, 0.5722260960511969, 0.30496827401352467, -0.17681649216052597, -0.5989055579789702, -0.9387419527992058], -1),
        "K1": ([0.3799534935023777, 0.55436941009677, 0.577490883303627, 0.3976981104157107, 0.057389181608905715, -0.27499308050187365, -0.5860270653995225], -1),
    }
    df = spark.createDataFrame([(b, s, v) for b, (vs, _) in blocks.items() for s, v in zip(range(-3, 4), vs)], "block string, shift int, r2 double")
    assert {r["block"]: r["selected_shift"] for r in align.best_shift(df, ["block"]).collect()} == {b: s for b, (_, s) in blocks.items()}


def test_calendar_on_both_grids(spark):
    r = features.add_calendar(hourly_panel(spark, {"a": [1.0] * 30}), HOURLY).orderBy("slot").collect()[25]
    assert (r["hour"], r["month"], r["dow"], r["season_slot"]) == (1, 6, 0, 1)
