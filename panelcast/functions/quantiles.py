"""Exact quantiles without holding a group in one aggregation buffer.

The built-in ``percentile`` keeps every distinct value of a group in one hash map. The
rank search below never does: count equal values, count value bins, find the bins that
hold the wanted ranks, and rank only inside those bins. Counts of bins add up, so where
a row belongs to several overlapping groups (folds), it is counted once per set of groups
and only counts are spread over them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_OCTAVE = 256


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], spread: str | None = None
) -> DataFrame:
    """``keys, prob, value, n``: linear-interpolation quantiles of non-NULL values.

    ``spread`` names an array of structs, the further groups that a row is in; their
    fields become keys. Rows are not copied for them. Reads ``df`` twice.
    """
    once = [*keys, spread] if spread else list(keys)
    keys = list(keys) + ([f.name for f in df.schema[spread].dataType.elementType.fields] if spread else [])

    def over_groups(counts: DataFrame) -> DataFrame:
        return counts.select("*", F.inline(spread)).drop(spread) if spread else counts

    v = F.col("_v")
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*once, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_c"))
        .withColumn(
            "_bin",
            (F.signum(v) * F.floor(F.log2(1.0 + F.abs(v)) * BINS_PER_OCTAVE)).cast("bigint"),
        )
    )
    order = Window.partitionBy(*keys).orderBy("_bin")
    bins = (
        over_groups(counts.groupBy(*once, "_bin").agg(F.sum("_c").alias("_c")))
        .groupBy(*keys, "_bin")
        .agg(F.sum("_c").alias("_bc"))
        .withColumn("_upto", F.sum("_bc").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_n", F.sum("_bc").over(Window.partitionBy(*keys)))
    )
    spec = F.array(*[F.lit(float(p)) for p in probs])
    pos = F.col("prob") * (F.col("_n") - 1)
    wanted = (
        bins.withColumn("prob", F.explode(spec))
        .withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor(pos), F.ceil(pos)))))
        .where((F.col("_rank") >= F.col("_upto") - F.col("_bc")) & (F.col("_rank") < F.col("_upto")))
        .select(*keys, "_bin", "prob", "_rank", "_n", (F.col("_upto") - F.col("_bc")).alias("_base"))
    )
    hit_bins = wanted.select(*keys, "_bin", "_base").distinct()
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v")
    near = counts
    if spread:  # values in wanted bins only, before they are spread
        shared = [k for k in once if k != spread]
        near = over_groups(counts.join(hit_bins.select(*shared, "_bin").distinct(), [*shared, "_bin"], "left_semi"))
        near = near.groupBy(*keys, "_bin", "_v").agg(F.sum("_c").alias("_c"))
    ranked = (
        near.join(hit_bins, [*keys, "_bin"])
        .withColumn(
            "_hi",
            F.col("_base") + F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
        .select(*keys, "_bin", "_v", "_lo", "_hi")
    )
    picked = wanted.join(ranked, [*keys, "_bin"]).where(
        (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    )
    frac = F.col("prob") * (F.max("_n") - 1)
    low, high = F.min_by("_v", "_rank"), F.max_by("_v", "_rank")
    return picked.groupBy(*keys, "prob").agg(
        (low + (high - low) * (frac - F.floor(frac))).alias("value"), F.max("_n").alias("n")
    )
