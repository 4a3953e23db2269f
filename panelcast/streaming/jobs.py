"""Hourly regularisation of arriving readings, and a running error monitor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery


def hourly_values(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly sums of a stream with ``series_id, ts, value``.

    Readings later than the watermark are dropped; windows close behind it. Sums
    are decimal, so they equal the batch ones bit for bit.
    """
    return (
        readings.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour"), "series_id")
        .agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("y"), F.count("*").alias("n"))
        .select("series_id", F.col("window.start").cast("timestamp_ntz").alias("ts"), "y", "n")
    )


def error_monitor(values: DataFrame, forecasts: DataFrame, late: str = "1 day", by: Sequence[str] = ()) -> DataFrame:
    """Daily error sums per series and model of arriving values against stored forecasts.

    ``values`` streams ``series_id, ts, y``; ``forecasts`` is a static table
    ``series_id, ts, model, yhat`` and further keys ``by``.
    """
    stored = forecasts.select("series_id", F.col("ts").cast("timestamp").alias("ts"), "model", "yhat", *by)
    e = F.col("y") - F.col("yhat")
    return (
        values.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", late)
        .join(stored, ["series_id", "ts"])
        .groupBy(F.window("ts", "1 day"), "series_id", "model", *by)
        .agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
        .select("series_id", "model", *by, F.col("window.start").cast("date").alias("day"), "n", "rmse", "mae")
    )


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is available, then stop; the checkpoint makes a restart exact."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    return query


def run_latest(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> DataFrame:
    """Process what is available and return the last state of every window, open or closed.

    Each micro-batch writes the windows it changed to a folder of its own, which a
    repeated batch overwrites; the latest row of a key is its state.
    """
    spark = stream.sparkSession
    schema = stream.schema

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not query.recentProgress:
        return spark.createDataFrame([], schema)
    saved = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    rest = [c for c in stream.columns if c not in keys]
    latest = saved.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_s"))
    return latest.select(*keys, "_s.*").select(*stream.columns)
