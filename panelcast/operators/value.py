"""Cost of committing to a forecast: shortfall costs ``ratio``, surplus costs 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import observed

RATIOS = (1.0, 2.0, 3.0, 5.0)


def _parts(commitment: Column) -> tuple[Column, Column]:
    c = F.greatest(commitment, F.lit(0.0))
    return F.greatest(c - F.col("y"), F.lit(0.0)), F.greatest(F.col("y") - c, F.lit(0.0))


def commitment_cost(pred: DataFrame, keys: Sequence[str], ratios: Sequence[float] = RATIOS) -> DataFrame:
    """``keys, ratio, cost`` per delivered unit over observed rows.

    Shortfall and surplus are summed once; the ratios are applied to the sums.
    """
    short, surplus = _parts(F.col("yhat"))
    sums = observed(pred).groupBy(*keys).agg(
        F.sum(short).alias("_s"), F.sum(surplus).alias("_u"), F.sum("y").alias("_d")
    )
    r = F.col("ratio")
    return sums.withColumn("ratio", F.explode(F.array(*[F.lit(x) for x in ratios]))).select(
        *keys, "ratio", F.when(F.col("_d") > 0, (r * F.col("_s") + F.col("_u")) / F.col("_d")).alias("cost")
    )


def tuned_cost(
    pred: DataFrame,
    keys: Sequence[str],
    ratios: Sequence[float] = (2.0, 3.0, 5.0),
    lo: int = 20,
    hi: int = 150,
) -> DataFrame:
    """Cost after scaling the forecast by a factor (in 1/100) chosen on the other folds.

    A row falls short from the first factor on at which its scaled forecast exceeds ``y``, so
    rows are summed by that factor, and running sums over the factors give shortfall and
    surplus of each. The factor for a fold minimises total minus own; the smallest wins a tie.
    """
    keys = list(keys)
    f = F.col("_pct") / 100.0
    c, y = F.greatest(F.col("yhat"), F.lit(0.0)), F.col("y")
    first = F.when(y < 0, lo).when(c > 0, F.floor(F.least(100.0 * y / c, F.lit(float(hi)))) + 1).otherwise(hi + 1)
    broken = observed(pred).groupBy(*keys, "fold", F.greatest(first, F.lit(lo)).cast("int").alias("_pct")).agg(
        F.sum(c).alias("_c"), F.sum(y).alias("_y")
    )
    # from here on one row per fold and factor
    whole = broken.groupBy(*keys, "fold").agg(F.sum("_c").alias("_all"), F.sum("_y").alias("_d"))
    steps = whole.withColumn("_pct", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).join(broken, [*keys, "fold", "_pct"], "left")
    upto = Window.partitionBy(*keys, "fold").orderBy("_pct").rowsBetween(Window.unboundedPreceding, 0)
    so_far = lambda n: F.coalesce(F.sum(n).over(upto), F.lit(0.0))
    sums = steps.withColumn("_s", f * so_far("_c") - so_far("_y")).withColumn("_u", F.col("_d") - f * F.col("_all") + F.col("_s"))
    sums = sums.select(*keys, "fold", "_pct", "_s", "_u", "_d")
    across = Window.partitionBy(*keys, "_pct")
    names = ("_s", "_u", "_d")
    other = sums.withColumns({f"_o{n}": F.sum(n).over(across) - F.col(n) for n in names}).withColumn(
        "_folds", F.count("*").over(across)
    )
    r = F.col("ratio")
    costs = (
        other.where(F.col("_folds") > 1)
        .withColumn("ratio", F.explode(F.array(*[F.lit(x) for x in ratios])))
        .withColumn("_c", F.round((r * F.col("_o_s") + F.col("_o_u")) / F.col("_o_d"), 9))
    )
    chosen = costs.groupBy(*keys, "fold", "ratio").agg(
        F.min_by(F.struct("_pct", "_s", "_u", "_d"), F.struct("_c", "_pct")).alias("_b")
    )
    return chosen.groupBy(*keys, "ratio").agg(
        (F.sum(r * F.col("_b._s") + F.col("_b._u")) / F.sum("_b._d")).alias("tuned_cost"),
        (F.avg("_b._pct") / 100.0).alias("mean_scale"),
    )


def value_table(pred: DataFrame, keys: Sequence[str], reference: str, group: Sequence[str]) -> DataFrame:
    """Plain and tuned cost, saving from tuning, and cost skill against a reference model."""
    plain = commitment_cost(pred, keys)
    tuned = tuned_cost(pred, keys)
    ref = F.max(F.when(F.col("model") == reference, F.col("cost"))).over(
        Window.partitionBy(*group, "ratio")
    )
    return (
        plain.join(tuned, [*keys, "ratio"], "left")
        .withColumn("saving_pct", F.when(F.col("cost") > 0, 100.0 * (F.col("cost") - F.col("tuned_cost")) / F.col("cost")))
        .withColumn("cost_skill", F.when(ref != 0, 1.0 - F.col("cost") / ref))
    )
