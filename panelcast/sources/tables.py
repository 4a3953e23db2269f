"""Canonical panels and drivers built from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.time import DAILY, HOURLY, Grid, ensure_utc, slot_of
from ..operators.grid import regular_grid, slot_spans


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings_h(spark: SparkSession, sf_dir: str, series: str = "event_type") -> DataFrame:
    return load(spark, sf_dir, "events").select(
        F.col(series).cast("string").alias("series_id"),
        slot_of(F.col("ts"), HOURLY).alias("slot"),
        F.col("value").cast("decimal(18,2)").alias("v"),
    )


def readings_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("series_id"),
        slot_of(F.col("l_shipdate"), DAILY).alias("slot"),
        (F.col("l_extendedprice").cast("decimal(18,2)") * net).cast("decimal(20,4)").alias("v"),
    )


def _panel(raw: DataFrame, grid: Grid, bounds: bool = False) -> DataFrame:
    values = raw.groupBy("series_id", "slot").agg(F.sum("v").cast("double").alias("y"))
    return regular_grid(values, grid, spans=slot_spans(raw), bounds=bounds)


def panel_h(spark: SparkSession, sf_dir: str, bounds: bool = False) -> DataFrame:
    """Hourly value per event type."""
    return _panel(readings_h(spark, sf_dir), HOURLY, bounds)


def panel_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly value per user: many sparse series."""
    return _panel(readings_h(spark, sf_dir, "user_id"), HOURLY)


def panel_d(spark: SparkSession, sf_dir: str, bounds: bool = False) -> DataFrame:
    """Daily net revenue per return flag."""
    return _panel(readings_d(spark, sf_dir), DAILY, bounds)


def exog_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly drivers over all event types."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return (
        load(spark, sf_dir, "events")
        .groupBy(slot_of(F.col("ts"), HOURLY).alias("slot"))
        .agg(
            F.count("*").cast("double").alias("n_events"),
            (F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("mean_value"),
            (F.sum(k).cast("double") / F.count(k)).alias("mean_k"),
        )
    )


def exog_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily drivers from orders."""
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return (
        load(spark, sf_dir, "orders")
        .groupBy(slot_of(F.col("o_orderdate"), DAILY).alias("slot"))
        .agg(F.count("*").cast("double").alias("n_orders"), (total / F.count("*")).alias("mean_price"))
    )
