"""Write an intermediate table once and read it back, so that several consumers
share it, lineage is cut and a lost executor costs only its own tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        current = tempfile.mkdtemp(prefix="panelcast-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/panelcast/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
