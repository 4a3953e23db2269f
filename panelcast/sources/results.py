"""Stored prediction facts and result tables, kept apart by run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREDICTION_COLUMNS = (
    "protocol",
    "fold",
    "series_id",
    "ts",
    "model",
    "y",
    "yhat",
    "active",
    "is_missing",
)


def prediction_facts(parts: list[DataFrame]) -> DataFrame:
    """Union of per-protocol or per-fold predictions in one long table."""
    cols = [c for c in (*PREDICTION_COLUMNS, "role", "slot") if all(c in p.columns for p in parts)]
    return reduce(DataFrame.unionByName, [p.select(*cols) for p in parts])


def write_run(df: DataFrame, path: str, run: str, parts: tuple[str, ...] = ()) -> None:
    """Write under ``run=<run>``; a rewrite replaces the partitions it writes, no others."""
    (
        df.withColumn("run", F.lit(run))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", *parts)
        .parquet(path)
    )


def read_run(spark, path: str, run: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("run") == run)


def tagged(name: str, tag: str | None) -> str:
    """``metrics.csv`` with tag ``a`` becomes ``metrics__a.csv``."""
    if not tag:
        return name
    stem, dot, ext = name.rpartition(".")
    return f"{stem}__{tag}.{ext}" if dot else f"{name}__{tag}"
