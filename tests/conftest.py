import os
import sys
from datetime import datetime, timedelta

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .appName("panelcast-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


START = datetime(2025, 6, 1)
START_SLOT = int((START - datetime(1970, 1, 1)).total_seconds() // 3600)
PANEL = "series_id string, slot bigint, ts timestamp_ntz, y double, y_filled double, is_missing boolean"


def hourly_panel(spark, series: dict, start: datetime = START, extra: dict | None = None):
    """Panel from ``{series_id: [y or None, ...]}``, one value per hour from ``start``."""
    base = int((start - datetime(1970, 1, 1)).total_seconds() // 3600)
    extra = extra or {}
    rows = [
        (sid, base + i, start + timedelta(hours=i), y, max(y, 0.0) if y is not None else 0.0, y is None)
        + tuple(vals[i] for vals in extra.values())
        for sid, ys in series.items()
        for i, y in enumerate(ys)
    ]
    schema = PANEL + "".join(f", {n}" for n in extra)
    return spark.createDataFrame(rows, schema)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
