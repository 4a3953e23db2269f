"""Leakage-safe splits as tables of days.

A split table has one row per ``series_id, protocol, fold, day, role`` with role
``train``, ``val`` or ``test``. It is built from one row per series and day, so
its windows hold a day list, not readings.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import row_ranks
from ..functions.draws import draw_key
from ..functions.quantiles import exact_quantiles
from ..functions.time import day_of

ROLLING = "rolling_origin"
RANDOM = "random_day"


def _fold_rows(days: DataFrame, n_folds: int, order: Column) -> DataFrame:
    by_series = Window.partitionBy("series_id")
    return (
        days.withColumn("_pos", F.row_number().over(by_series.orderBy(order)) - 1)
        .withColumn("_n", F.count("*").over(by_series))
        .withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    )


def _with_validation(cand: DataFrame, size: Column, order: Sequence[Column]) -> DataFrame:
    """Turn the first ``size`` candidate days by ``order`` into validation days."""
    w = Window.partitionBy("series_id", "_f", "_cand")
    return (
        cand.withColumn("_k", F.count("*").over(w))
        .withColumn("_r", F.row_number().over(w.orderBy(*order)))
        .withColumn(
            "role",
            F.when(F.col("_test"), "test").when(
                F.col("_cand"), F.when(F.col("_r") <= size, "val").otherwise("train")
            ),
        )
        .where(F.col("role").isNotNull())
    )


def _share(n: Column, share: float) -> Column:
    """``share`` of a count, as the decimal it is written as: 0.7 of 90 is 63, not a hair less."""
    return n * F.lit(Decimal(str(share)))


def validation_tail_size(frac: float, at_least: int) -> Column:
    k = F.col("_k")
    wanted = F.greatest(F.lit(at_least), F.ceil(_share(k, frac)).cast("int"))
    return F.least(wanted, F.greatest(k - 1, F.lit(1)))


def rolling_origin(
    days: DataFrame,
    n_folds: int = 4,
    first_test_days: int = 120,
    min_train_rows: int = 200,
    val_frac: float = 0.15,
    min_val_days: int = 7,
) -> DataFrame:
    """Consecutive test blocks after a training-only head; the last takes the remainder.

    ``days`` has ``series_id, day, n_obs``. Training days are those before the
    block with an observation; the most recent of them are the validation tail.
    """
    length = F.floor((F.col("_n") - first_test_days) / n_folds)
    start = first_test_days + F.col("_f") * length
    end = F.when(F.col("_f") == n_folds - 1, F.col("_n")).otherwise(start + length)
    rows = (
        _fold_rows(days, n_folds, F.col("day"))
        .where(length >= 1)
        .withColumn("_cand", (F.col("_pos") < start) & (F.col("n_obs") > 0))
        .withColumn("_test", (F.col("_pos") >= start) & (F.col("_pos") < end))
        .where("_cand or _test")
        .withColumn(
            "_train_rows",
            F.sum(F.when(F.col("_cand"), F.col("n_obs"))).over(Window.partitionBy("series_id", "_f")),
        )
        .where(F.col("_train_rows") >= min_train_rows)
    )
    return _with_validation(
        rows, validation_tail_size(val_frac, min_val_days), [F.col("day").desc()]
    ).select(
        "series_id",
        F.lit(ROLLING).alias("protocol"),
        F.concat(F.lit("T"), F.col("_f") + 1).alias("fold"),
        "day",
        "role",
    )


def random_days(
    days: DataFrame, n_folds: int = 5, seed: int | Column = 0, val_frac: float = 0.10, min_val_days: int = 7
) -> DataFrame:
    """Seeded partition of days into test folds; other observed days train, some validate.

    The order is that of a hash of (seed, day): the same on any cluster layout.
    """
    seed_col = seed if isinstance(seed, Column) else F.lit(seed)
    size = F.floor(F.col("_n") / n_folds)
    rows = (
        _fold_rows(days, n_folds, F.struct(draw_key(seed_col, F.col("day")), F.col("day")))
        .withColumn(
            "_test",
            F.col("_f")
            == F.when(size > 0, F.least(F.floor(F.col("_pos") / F.greatest(size, F.lit(1))), F.lit(n_folds - 1))).otherwise(n_folds - 1),
        )
        .withColumn("_cand", ~F.col("_test") & (F.col("n_obs") > 0))
        .where("_cand or _test")
    )
    n_val = F.greatest(F.lit(min_val_days), F.floor(_share(F.col("_k"), val_frac)).cast("int"))
    return _with_validation(
        rows, n_val, [draw_key(seed_col + F.col("_f"), F.col("day")), F.col("day")]
    ).select(
        "series_id",
        F.lit(RANDOM).alias("protocol"),
        F.concat(F.lit("K"), F.col("_f") + 1).alias("fold"),
        "day",
        "role",
    )


def both_protocols(days: DataFrame, rolling: dict | None = None, random: dict | None = None) -> DataFrame:
    return rolling_origin(days, **(rolling or {})).unionByName(random_days(days, **(random or {})))


def memberships(splits: DataFrame) -> DataFrame:
    """One row per series and day: ``train_of`` and ``eval_of`` list the folds it serves.

    Joining this to a panel keeps the row count; days with the same ``train_of``
    can be aggregated together before being counted once per fold.
    """
    fold = F.struct("protocol", "fold")
    ev = F.struct("protocol", "fold", "role")
    return splits.groupBy("series_id", "day").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "train", fold))).alias("train_of"),
        F.array_sort(F.collect_list(F.when(F.col("role") != "train", ev))).alias("eval_of"),
    )


def assign(frame: DataFrame, splits: DataFrame) -> DataFrame:
    """Attach ``train_of`` and ``eval_of`` to the rows of a panel."""
    return frame.withColumn("day", day_of(F.col("ts"))).join(
        memberships(splits), ["series_id", "day"]
    )


def train_rows(assigned: DataFrame) -> DataFrame:
    """Observed training rows, one per fold they serve."""
    return (
        assigned.where(~F.col("is_missing"))
        .withColumn("_t", F.explode("train_of"))
        .withColumns({"protocol": F.col("_t.protocol"), "fold": F.col("_t.fold")})
        .drop("_t", "train_of", "eval_of")
    )


def eval_rows(assigned: DataFrame) -> DataFrame:
    """Validation and test rows, one per fold and role they serve."""
    return (
        assigned.withColumn("_e", F.explode("eval_of"))
        .withColumns({c: F.col(f"_e.{c}") for c in ("protocol", "fold", "role")})
        .drop("_e", "train_of", "eval_of")
    )


def fold_sums(assigned: DataFrame, sums: dict[str, Column], by: dict[str, Column] | None = None) -> DataFrame:
    """Sums over each fold's observed training rows without copying rows per fold.

    Rows are summed once per (series, set of folds, key); only those partial sums
    are spread over the folds. NULLs inside a sum are skipped.
    """
    by = by or {}
    once = (
        assigned.where(~F.col("is_missing") & (F.size("train_of") > 0))
        .groupBy("series_id", "train_of", *[c.alias(k) for k, c in by.items()])
        .agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    )
    return (
        once.withColumn("_t", F.explode("train_of"))
        .groupBy("series_id", F.col("_t.protocol").alias("protocol"), F.col("_t.fold").alias("fold"), *by)
        .agg(*[F.sum(n).alias(n) for n in sums])
    )


def hide_history(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Per fold, the values a history feature may use: 0 and unavailable on held-out days."""
    joined = rows.withColumn("day", day_of(F.col("ts"))).join(splits, ["series_id", "day"])
    visible = F.col("role") == "train"
    return joined.withColumns(
        {
            "history_y": F.when(visible, F.col("y_filled")).otherwise(0.0),
            "history_available": visible & ~F.col("is_missing"),
        }
    )


def fold_capacity(assigned: DataFrame, overall: DataFrame, q: float = 0.999, min_rows: int = 50) -> DataFrame:
    """Capacity per fold from its training rows, or the series' when there are too few.

    Ranks are searched in counts per set of folds; rows are not copied per fold. Reads
    ``assigned`` twice."""
    rows = assigned.where(~F.col("is_missing") & (F.size("train_of") > 0)).select("series_id", "y_filled", "train_of")
    per_fold = exact_quantiles(rows, ["series_id"], "y_filled", [q], spread="train_of")
    enough = F.col("n") > min_rows
    return per_fold.join(overall, "series_id").select(
        "series_id", "protocol", "fold", F.col("n").alias("n_train"),
        F.when(enough, F.col("value")).otherwise(F.col("capacity")).alias("capacity"),
    )


def walk_forward(days: DataFrame, warmup: int = 120, step: int = 14, min_train_rows: int = 1000) -> DataFrame:
    """Test days of a growing-train walk: ``series_id, fold, origin, day, n_train``.

    An origin falls every ``step`` days after ``warmup``; training is every day
    before the origin, so it is described by the origin and its row count.
    """
    w = Window.partitionBy("series_id").orderBy("day")
    first = F.min("day").over(Window.partitionBy("series_id"))
    age = F.datediff("day", F.col("_first"))
    block = F.floor((age - warmup) / step).cast("int")
    rows = (
        days.withColumn("_first", first)
        .withColumn("_before", F.coalesce(F.sum("n_obs").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .where(age >= warmup)
        .withColumn("_b", block)
        .withColumn("origin", F.date_add("_first", F.lit(warmup) + F.col("_b") * step))
    )
    at_origin = Window.partitionBy("series_id", "_b")
    return (
        rows.withColumn("n_train", F.min("_before").over(at_origin))
        .where(F.col("n_train") >= min_train_rows)
        .select(
            "series_id",
            F.concat(F.lit("W"), F.col("_b") + 1).alias("fold"),
            "origin",
            "day",
            "n_obs",
            "n_train",
        )
    )


def time_split(panel: DataFrame, kind: str, value: float, at_least: int = 0, seed: int = 0) -> DataFrame:
    """Two-way splits of older protocols; adds ``role`` (train / val or test).

    ``tail_share``: the last ``max(at_least, value * n)`` rows validate.
    ``head_share``: the first ``value`` of rows train, the rest test.
    ``tail_days``: rows within ``value`` days of the end test.
    ``head_days_share``: the first ``value`` of the days train, the rest test.
    ``random_rows``: a seeded share ``value`` of rows validates.
    """
    if kind == "random_rows":
        # the rows with the smallest hashes would need a sort of everything; the
        # hash itself is uniform, so its threshold gives the share
        u = F.conv(F.substring(draw_key(str(seed), F.col("series_id"), F.col("slot")), 1, 8), 16, 10).cast("double") / float(2**32)
        return panel.withColumn("role", F.when(u < value, "val").otherwise("train"))
    if kind in ("tail_share", "head_share"):
        ranked = row_ranks(panel, ["series_id"])
        if kind == "tail_share":
            k = F.greatest(F.lit(at_least), F.floor(_share(F.col("n_rows"), value)))
            role = F.when(F.col("rank") > F.col("n_rows") - k, "val").otherwise("train")
        else:
            role = F.when(F.col("rank") <= F.floor(_share(F.col("n_rows"), value)), "train").otherwise("test")
        return ranked.withColumn("role", role).drop("rank", "n_rows")
    if kind == "tail_days":
        end = panel.groupBy("series_id").agg(F.max("ts").alias("_end"))
        cut = F.col("_end") - F.make_dt_interval(days=F.lit(int(value)))
        return (
            panel.join(end, "series_id")
            .withColumn("role", F.when(F.col("ts") < cut, "train").otherwise("test"))
            .drop("_end")
        )
    if kind == "head_days_share":
        days = panel.select("series_id", day_of(F.col("ts")).alias("day")).distinct()
        by_series = Window.partitionBy("series_id")
        roles = days.withColumn("_r", F.row_number().over(by_series.orderBy("day"))).withColumn(
            "_n", F.count("*").over(by_series)
        )
        role = F.when(F.col("_r") <= F.floor(_share(F.col("_n"), value)), "train").otherwise("test")
        return (
            panel.withColumn("day", day_of(F.col("ts")))
            .join(roles.select("series_id", "day", role.alias("role")), ["series_id", "day"])
            .drop("day")
        )
    raise ValueError(f"unknown split {kind!r}")
