"""Boosted-tree forecasts through Spark ML.

Each fit is one distributed job over the rows it is given. Trees are Spark's, so
forecasts differ from those of other boosting libraries.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.draws import draw_int, draw_key
from ..functions.stage import stage


def held_out(share: float, *parts) -> Column:
    """Seeded flag for early stopping, by hash of the row's key."""
    return draw_int(F.lit(1_000_000), *parts) < int(share * 1_000_000)


def fit_boosting(
    train: DataFrame,
    features: Sequence[str],
    label: str = "y",
    rounds: int = 100,
    rate: float = 0.04,
    depth: int = 5,
    min_leaf: int = 30,
    validation: str | None = None,
    seed: int = 0,
) -> PipelineModel:
    """Gradient-boosted trees; ``validation`` names a boolean early-stopping column.

    A missing feature takes its mean over the training rows, and a column of its own
    says so; no row is left out of the fit or of a forecast.
    """
    gbt = GBTRegressor(
        featuresCol="_features",
        labelCol=label,
        predictionCol="_pred",
        maxIter=rounds,
        stepSize=rate,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        seed=seed,
    )
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    means = train.agg(*[F.coalesce(F.avg(F.when(C.finite(F.col(f).cast("double")), F.col(f))), F.lit(0.0)).alias(f) for f in features]).first()
    known = {f: f"abs(CAST(`{f}` AS DOUBLE)) < CAST('Infinity' AS DOUBLE)" for f in features}
    full = [f"CASE WHEN {known[f]} THEN CAST(`{f}` AS DOUBLE) ELSE CAST('{means[f]!r}' AS DOUBLE) END AS `_full_{f}`" for f in features]
    gaps = [f"CASE WHEN {known[f]} THEN 0.0D ELSE 1.0D END AS `_gap_{f}`" for f in features]
    fill = SQLTransformer(statement=f"SELECT *, {', '.join(full + gaps)} FROM __THIS__")
    assembler = VectorAssembler(inputCols=[f"_{k}_{f}" for k in ("full", "gap") for f in features], outputCol="_features", handleInvalid="error")
    return Pipeline(stages=[fill, assembler, gbt]).fit(train)


def predict(model: PipelineModel, rows: DataFrame, name: str, post: Column | None = None) -> DataFrame:
    """Forecast column, floored at 0."""
    value = F.greatest(F.col("_pred") if post is None else post, F.lit(0.0))
    return model.transform(rows).select(*[F.col(c) for c in rows.columns], value.alias(name))


def boosted(train: DataFrame, rows: DataFrame, features: Sequence[str], name: str = "GBM", **options) -> DataFrame:
    return predict(fit_boosting(train, features, **options), rows, name)


def boosted_ratio(
    train: DataFrame,
    rows: DataFrame,
    features: Sequence[str],
    driver: str,
    capacity: Column,
    bound: float | None = 1.5,
    floor: float = 50.0,
    min_rows: int = 200,
    name: str = "GBM_kt",
    **options,
) -> DataFrame:
    """Boost the ratio to ``capacity * driver / 1000`` and scale back; 0 where the
    driver is below ``floor``. Too few usable rows: boost ``y`` itself."""
    usable = train.where(F.col(driver) > floor).withColumn("_kt", C.ratio(F.col("y"), capacity, F.col(driver), bound))
    if len(usable.select(driver).limit(min_rows + 1).collect()) <= min_rows:
        return boosted(train, rows, features, name, **options)
    model = fit_boosting(usable, features, label="_kt", **options)
    kt = F.greatest(F.col("_pred"), F.lit(0.0))
    if bound is not None:
        kt = F.least(kt, F.lit(float(bound)))
    value = F.when(F.col(driver) < floor, 0.0).otherwise(kt * C.envelope(capacity, F.col(driver)))
    return predict(model, rows, name, value)


def boosted_per_hour(train: DataFrame, rows: DataFrame, features: Sequence[str], hours: Sequence[int] = tuple(range(24)), min_rows: int = 30, name: str = "GBM_per_hour", **options) -> DataFrame:
    """One model per hour of day; hours with fewer than ``min_rows`` rows forecast 0.

    The number of fits is the number of hours, not a function of the data.
    """
    counts = {
        r["h"]: r["n"]
        for r in train.groupBy(F.hour("ts").alias("h")).agg(F.count("*").alias("n")).collect()
    }
    parts = []
    for h in hours:
        here = rows.where(F.hour("ts") == h)
        if counts.get(h, 0) < min_rows:
            parts.append(here.withColumn(name, F.lit(0.0)))
        else:
            parts.append(boosted(train.where(F.hour("ts") == h), here, features, name, **options))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def permutation_importance(
    model: PipelineModel,
    rows: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    label: str = "y",
    repeats: int = 3,
    seed: int = 0,
    rows_a_bucket: int = 4096,
) -> DataFrame:
    """Mean RMSE increase when a feature's values are dealt to other rows.

    All rows are used. The deal pairs rows by rank of two hashes, and ranks are taken
    inside hash buckets of about ``rows_a_bucket`` rows, so no task sees all rows.
    """
    key = [F.col(k) for k in keys]
    base = stage(rows.select(*keys, label, *features), "permuted")
    buckets = max(1, base.count() // rows_a_bucket)
    bucket = draw_int(F.lit(buckets), "bucket", str(seed), *key)
    parts = [base.withColumns({"feature": F.lit("-"), "repeat": F.lit(0)})]
    for f in features:
        for r in range(repeats):
            put = Window.partitionBy("_b").orderBy(draw_key("put", str(seed), f, str(r), *key))
            take = Window.partitionBy("_b").orderBy(draw_key("take", str(seed), f, str(r), *key))
            b = base.withColumn("_b", bucket)
            left = b.withColumn("_i", F.row_number().over(put)).drop(f)
            right = b.select("_b", f, F.row_number().over(take).alias("_i"))
            parts.append(
                left.join(right, ["_b", "_i"]).drop("_b", "_i").withColumns({"feature": F.lit(f), "repeat": F.lit(r)})
            )
    scored = predict(model, reduce(DataFrame.unionByName, parts), "_yhat")
    e = F.col(label) - F.col("_yhat")
    rmse = scored.groupBy("feature", "repeat").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    # a handful of rows: features x repeats
    base_rmse = F.max(F.when(F.col("feature") == "-", F.col("rmse"))).over(Window.partitionBy(F.lit(0)))
    return (
        rmse.withColumn("_base", base_rmse)
        .where(F.col("feature") != "-")
        .groupBy("feature")
        .agg(F.avg(F.col("rmse") - F.col("_base")).alias("importance"))
    )
