"""Streaming runs over the driver tables, compared with their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.stage import shared_folder
from ..operators.metrics import to_long
from ..plans.datasets import H, stored_forecasts
from ..sources import tables
from ..streaming.jobs import error_monitor, hourly_values, run_latest
from .registry import query, tidy
from .sql import r, sql


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/panelcast/stream-{uuid.uuid4().hex}"


def _events(spark, sf):
    static = tables.load(spark, sf, "events")
    stream = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.select(F.col("event_type").alias("series_id"), "ts", "value")


@query(
    "st1_hourly_stream",
    sql("SELECT series_id, make_timestamp(slot * 3600000000) AS ts, CAST(sum(v) AS DOUBLE) AS y, count(*) AS n FROM raw_h GROUP BY series_id, slot"),
)
def st1_hourly_stream(spark, sf):
    """Every window with what has arrived, the open ones too."""
    out = _folder(spark)
    return run_latest(hourly_values(_events(spark, sf)), ["series_id", "ts"], f"{out}/data", f"{out}/state")


@query(
    "st2_error_monitor",
    sql(
        f"""SELECT series_id, protocol, model, CAST(day AS VARCHAR) AS day, count(*) AS n, {r('sqrt(avg((y - yhat)**2))')} AS rmse, {r('avg(abs(y - yhat))')} AS mae
        FROM obs_h GROUP BY series_id, protocol, model, day"""
    ),
)
def st2_error_monitor(spark, sf):
    out = _folder(spark)
    tables.panel_h(spark, sf).where("y is not null").select("series_id", "ts", "y").write.parquet(f"{out}/values")
    wide = stored_forecasts(spark, sf, H).where("role = 'test'")
    stored = to_long(wide, ["Persistence", "Climatology", "SmartPersistence", "Scaled", "OLS2"])
    values = spark.readStream.schema("series_id string, ts timestamp_ntz, y double").parquet(f"{out}/values")
    monitor = error_monitor(values, stored, by=["protocol"])
    return tidy(run_latest(monitor, ["series_id", "protocol", "model", "day"], f"{out}/data", f"{out}/state"))
