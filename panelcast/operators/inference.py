"""Paired comparisons: Diebold-Mariano and day-block bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.draws import draw_int
from ..functions.stage import stage
from ..functions.special import student_t_two_sided
from ..functions.time import day_of
from .metrics import best_per_group, gain, observed, to_long, with_subsets


def loss_difference(a: str, b: str, loss: str) -> Column:
    ea, eb = F.col("y") - F.col(a), F.col("y") - F.col(b)
    ok = C.finite(ea, eb)
    if loss == "squared":
        return F.when(ok, ea * ea - eb * eb)
    if loss == "absolute":
        return F.when(ok, F.abs(ea) - F.abs(eb))
    raise ValueError("loss must be 'squared' or 'absolute'")


def dm_statistic(rows: DataFrame, keys: Sequence[str], a: str, b: str, loss: str = "squared") -> DataFrame:
    """``keys, n, mean_diff, statistic``; NULL below 8 pairs or without variance.

    Negative means ``a`` has the lower loss. Hours are treated as independent;
    prefer the day bootstrap for hourly data.
    """
    d = loss_difference(a, b, loss)
    ok = (F.col("n") >= 8) & (F.col("_var") > 0)
    return (
        rows.groupBy(*keys)
        .agg(F.count(d).alias("n"), F.avg(d).alias("mean_diff"), F.var_samp(d).alias("_var"))
        .withColumn("statistic", F.when(ok, F.col("mean_diff") / F.sqrt(F.col("_var") / F.col("n"))))
    )


def diebold_mariano(rows: DataFrame, keys: Sequence[str], a: str, b: str, loss: str = "squared", names: tuple[str, str] | None = None) -> DataFrame:
    """Statistic with a two-sided Student-t p-value (n - 1 df) and a verdict."""
    name_a, name_b = names or (a, b)
    out = dm_statistic(rows, keys, a, b, loss).withColumn(
        "p_value", student_t_two_sided("statistic", (F.col("n") - 1).cast("double"))
    )
    better = (
        F.when(F.col("n") < 8, "undetermined")
        .when(~(F.col("_var") > 0), "tie")
        .when(F.col("p_value") < 0.05, F.when(F.col("mean_diff") < 0, name_a).otherwise(name_b))
        .otherwise("no significant difference")
    )
    return out.withColumn("better", better).withColumn("loss", F.lit(loss)).drop("_var")


def day_losses(rows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    ea, eb = F.col("y") - F.col(a), F.col("y") - F.col(b)
    ok = C.finite(ea, eb)
    return (
        rows.where(ok)
        .groupBy(*keys, day_of(F.col("ts")).alias("day"))
        .agg(F.sum(ea * ea).alias("la"), F.sum(eb * eb).alias("lb"), F.count("*").alias("n"))
    )


def block_arrays(days: DataFrame, keys: Sequence[str], widths: Sequence[int]) -> DataFrame:
    """Per key and block width: loss sums of blocks of consecutive scored days.

    Blocks are counted over scored days, so calendar gaps collapse. A key holds at
    most one entry per day, which bounds the arrays.
    """
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("day")) - 1
    blocks = (
        days.withColumn("_p", pos)
        .withColumn("block_days", F.explode(F.array(*[F.lit(w) for w in widths])))
        .groupBy(*keys, "block_days", F.floor(F.col("_p") / F.col("block_days")).alias("_b"))
        .agg(F.sum("la").alias("la"), F.sum("lb").alias("lb"), F.sum("n").alias("n"), F.count("*").alias("_d"))
    )
    return blocks.groupBy(*keys, "block_days").agg(
        F.array_sort(F.collect_list(F.struct("_b", "la", "lb", F.col("n").cast("double").alias("n")))).alias("blocks"),
        F.sum("_d").alias("n_days"),
        F.sum("n").alias("n"),
        F.sum("la").alias("_la"),
        F.sum("lb").alias("_lb"),
    )


def block_bootstrap(
    days: DataFrame,
    keys: Sequence[str],
    n_boot: int = 10000,
    seed: int = 0,
    widths: Sequence[int] = (1,),
    lanes: int = 32,
) -> DataFrame:
    """Observed % RMSE gain of a over b with a percentile interval and p-value.

    ``days`` comes from :func:`day_losses`. A replicate draws as many blocks as
    there are, by hash of (seed, replicate, position). Replicates are dealt to
    ``lanes`` so that one comparison uses many tasks; a replicate is summed inside
    its row, so no (replicate x block) table is ever shuffled.
    """
    keys = [*keys, "block_days"]
    arrays = stage(block_arrays(days, keys[:-1], widths), "blocks")
    packed = arrays.where(F.col("n_days") >= 8)
    size = -(-n_boot // lanes)
    partitions = max(lanes, int(days.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = packed.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))).repartition(
        partitions, *keys, "_lane"
    )
    lo = F.col("_lane") * size
    hi = F.least(lo + size, F.lit(n_boot)) - 1
    reps = dealt.where(lo < n_boot).withColumn("_rep", F.explode(F.sequence(lo, hi)))
    m = F.size("blocks")
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("n"))

    def add(acc: Column, j: Column) -> Column:
        hit = F.get("blocks", draw_int(m, str(seed), F.col("_rep"), j).cast("int"))
        return F.struct(
            (acc["a"] + hit["la"]).alias("a"), (acc["b"] + hit["lb"]).alias("b"), (acc["n"] + hit["n"]).alias("n")
        )

    drawn = reps.withColumn("_t", F.aggregate(F.sequence(F.lit(0), m - 1), zero, add))
    gain_pct = (1.0 - F.sqrt(F.col("_t.a")) / F.sqrt(F.col("_t.b"))) * 100.0
    diff = F.col("_t.a") - F.col("_t.b")
    q = F.percentile("_gain", [0.025, 0.975])
    tail = F.least(F.avg((F.col("_diff") >= 0).cast("double")), F.avg((F.col("_diff") <= 0).cast("double")))
    boot = (
        drawn.select(*keys, gain_pct.alias("_gain"), diff.alias("_diff"))
        .groupBy(*keys)
        .agg(
            q.getItem(0).alias("ci_low_pct"),
            q.getItem(1).alias("ci_high_pct"),
            F.least(F.greatest(2.0 * tail, F.lit(1.0 / n_boot)), F.lit(1.0)).alias("p_value"),
        )
    )
    seen = arrays.select(
        *keys,
        F.when(
            F.col("n_days") >= 8,
            (F.sqrt("_lb") - F.sqrt("_la")) / F.sqrt("_lb") * 100.0,
        ).alias("rel_rmse_gain_pct"),
        "n_days",
        "n",
    )
    return seen.join(boot, keys, "left")


def significance_table(
    wide: DataFrame,
    stack: str,
    comparator: str,
    bases: Sequence[str],
    ensembles: Sequence[str],
    keys: Sequence[str] = ("series_id", "protocol"),
    n_boot: int = 10000,
    seed: int = 0,
) -> DataFrame:
    """Declared stack against the validation-selected member, per subset.

    The lowest-error base and ensemble are reported for reference only.
    """
    keys = [*keys, "subset"]
    rows = with_subsets(observed(wide.where(F.col("role") == "test")))
    models = list(dict.fromkeys([*bases, *ensembles, stack, comparator]))
    e = F.col("y") - F.col("yhat")
    rmse = to_long(rows, models).groupBy(*keys, "model").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    # equal up to summation noise counts as a tie, settled by name
    rank = rmse.withColumn("_score", F.round("rmse", 7))
    low = lambda names, tag: best_per_group(rank.where(F.col("model").isin(*names)), keys, by="_score").select(
        *keys, F.col("model").alias(f"lowest_{tag}"), F.col("rmse").alias(f"lowest_{tag}_rmse")
    )
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("rmse")))
    gains = (
        rmse.groupBy(*keys)
        .agg(pick(stack).alias("_s"), pick(comparator).alias("_c"))
        .withColumn("abs_rmse_gain", gain(F.col("_s"), F.col("_c"))["abs_rmse_gain"])
        .drop("_s", "_c")
    )
    boot = block_bootstrap(day_losses(rows, keys, stack, comparator), keys, n_boot, seed)
    dm = dm_statistic(rows, keys, stack, comparator).select(*keys, F.col("statistic").alias("dm_statistic_hourly"))
    return (
        gains.join(boot.drop("block_days"), keys)
        .join(dm, keys)
        .join(low(bases, "base"), keys)
        .join(low(ensembles, "ensemble"), keys)
    )
