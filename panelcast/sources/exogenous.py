"""Driver (exogenous) tables: variable sets, suffixes and the provenance check."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the driver variables, in the order used as features.
FULL = (
    "temperature_2m",
    "relative_humidity_2m",
    "dew_point_2m",
    "cloud_cover",
    "cloud_cover_low",
    "cloud_cover_mid",
    "cloud_cover_high",
    "shortwave_radiation",
    "direct_radiation",
    "direct_normal_irradiance",
    "diffuse_radiation",
    "wind_speed_10m",
    "wind_gusts_10m",
    "precipitation",
    "pressure_msl",
)
LEVELS = ("cloud_cover_low", "cloud_cover_mid", "cloud_cover_high")
VARIABLE_SETS = {
    "full": FULL,
    "forecast_matched": tuple(v for v in FULL if v not in LEVELS),
}


def project_variables(df: DataFrame, variable_set: str, keys: Sequence[str] = ("ts",)) -> DataFrame:
    """Keep the keys and the set's variables that the table has."""
    if variable_set not in VARIABLE_SETS:
        raise ValueError(f"unknown variable set {variable_set!r}; use one of {sorted(VARIABLE_SETS)}")
    have = [c for c in VARIABLE_SETS[variable_set] if c in df.columns]
    return df.select(*keys, *have)


def strip_suffix(df: DataFrame, suffix: str) -> DataFrame:
    """Drop a product suffix from column names."""
    if not suffix:
        return df
    return df.withColumnsRenamed(
        {c: c[: -len(suffix)] for c in df.columns if c.endswith(suffix)}
    )


def load_product(
    spark: SparkSession,
    catalogue: dict[str, dict],
    product: str,
    variable_set: str = "full",
    manifest: DataFrame | None = None,
) -> DataFrame:
    """Read one driver product: ``catalogue[product] = {path, suffix}``."""
    if product not in catalogue:
        raise ValueError(f"unknown product {product!r}; use one of {sorted(catalogue)}")
    if manifest is None or manifest.where(F.col("source") == product).isEmpty():
        warnings.warn(f"no provenance record for product {product!r}", stacklevel=2)
    entry = catalogue[product]
    raw = (
        spark.read.parquet(entry["path"])
        if entry["path"].endswith(".parquet")
        else spark.read.csv(entry["path"], header=True)
    )
    raw = strip_suffix(raw, entry.get("suffix", "")).withColumnsRenamed({"time": "ts"})
    kept = project_variables(raw, variable_set)
    return kept.select(
        F.col("ts").cast("timestamp").cast("timestamp_ntz").alias("ts"),
        *[F.col(c).cast("string").try_cast("double").alias(c) for c in kept.columns if c != "ts"],
    )


def provenance(
    table: DataFrame, manifest: DataFrame, source: str, span: DataFrame, variables: Sequence[str]
) -> DataFrame:
    """One verdict row: is the stored table the wanted product over the wanted span?

    ``span`` is one row ``start, end``; ``manifest`` has ``source, n_rows``.
    """
    nulls = sum((F.col(v).isNull().cast("bigint") for v in variables), F.lit(0))
    facts = table.agg(
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.count("*").alias("n_rows"),
        F.sum(nulls).cast("bigint").alias("n_null"),
    )
    recorded = manifest.where(F.col("source") == source).agg(
        F.count("*").alias("_records"), F.max("n_rows").alias("_recorded_rows")
    )
    covers = (F.col("first_ts") <= F.col("start")) & (F.col("last_ts") >= F.col("end"))
    # the record and the span are one row each: scalar subqueries, no join
    return (
        facts.withColumns(
            {
                "_records": recorded.select("_records").scalar(),
                "_recorded_rows": recorded.select("_recorded_rows").scalar(),
                "start": span.select("start").scalar(),
                "end": span.select("end").scalar(),
            }
        )
        .select(
            F.lit(source).alias("source"),
            "first_ts",
            "last_ts",
            "n_rows",
            "n_null",
            (F.col("_records") > 0).alias("source_ok"),
            F.coalesce(covers, F.lit(False)).alias("span_ok"),
            F.coalesce(F.col("_recorded_rows") == F.col("n_rows"), F.lit(False)).alias("rows_ok"),
            ((F.col("_records") > 0) & F.coalesce(covers, F.lit(False))).alias("usable"),
        )
    )
