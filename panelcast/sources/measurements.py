"""Long-format measurement logs: one row per reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def keep_field(raw: DataFrame, field: str, series: Column, time: str = "_time", name: str = "_field", value: str = "_value") -> DataFrame:
    """``series_id, ts, value`` of one field; unparsable times drop out, values turn NULL."""
    return (
        raw.where(F.col(name) == field)
        .select(
            series.cast("string").alias("series_id"),
            F.col(time).cast("string").try_cast("timestamp").cast("timestamp_ntz").alias("ts"),
            F.col(value).cast("string").try_cast("double").alias("value"),
        )
        .where(F.col("ts").isNotNull())
    )


def read_long_csv(spark: SparkSession, path: str, field: str, series: str | None = None) -> DataFrame:
    """Read a commented CSV export and keep one field.

    ``series`` names the column holding the series; without it each file is one series.
    """
    raw = spark.read.csv(
        path,
        header=True,
        comment="#",
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
    )
    raw = raw.withColumnsRenamed({c: c.strip() for c in raw.columns})
    key = F.col(series) if series else F.col("_metadata.file_name")
    return keep_field(raw, field, key)


def read_long_parquet(spark: SparkSession, path: str, field: str, series: str) -> DataFrame:
    """The same from Parquet, where the field filter reaches the scan."""
    return keep_field(spark.read.parquet(path), field, F.col(series))
