"""Queries whose fits need a least number of rows do fit on the month of the driver tables."""

from pyspark.sql import functions as F

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.01"
QUERIES = entry_module.queries()


def test_weeks_with_gaps_count(spark):
    weeks = QUERIES["x24_representative_week"](spark, SF)
    most = weeks.groupBy("protocol").agg(F.max("n_weeks").alias("m")).collect()
    assert {r["protocol"]: r["m"] for r in most} == {"rolling_origin": 4, "random_day": 5}


def test_hours_get_weights(spark):
    key = ["protocol", "fold", "series_id", "ts"]
    mean = QUERIES["e01_mean"](spark, SF).withColumnRenamed("yhat", "mean")
    both = QUERIES["e08_per_hour_stack"](spark, SF).join(mean, key)
    assert both.where(F.abs(F.col("yhat") - F.col("mean")) > 0.01).count() > 1000


def test_hours_get_models(spark):
    out = QUERIES["m06_per_hour_ridge"](spark, SF)
    assert out.where("protocol = 'random_day' and yhat > 0").count() > 3000
    assert out.where("protocol = 'rolling_origin' and yhat > 0").count() > 500
