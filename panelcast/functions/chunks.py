"""Window work on long series without one task per series.

A series is cut into chunks of ``width`` slots, so even one very long series is
spread over many tasks. Three shapes cover every need here:

* bounded frames (lags, leads, rolling means): rows near a chunk edge are also
  sent to the neighbouring chunk, windows run per chunk, the copies are dropped;
* unbounded carries (forward/backward fill): fill inside chunks, then carry the
  last value over a table with one row per chunk;
* runs: runs inside chunks, then join only the runs that touch a chunk edge.

Results do not depend on ``width``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

WIDTH = 8192


def _chunk(width: int) -> Column:
    return F.floor(F.col("slot") / F.lit(width)).cast("bigint")


def bounded_window(
    df: DataFrame,
    keys: Sequence[str],
    build: Callable[[WindowSpec], dict[str, Column]],
    before: int,
    after: int,
    width: int = WIDTH,
) -> DataFrame:
    """Add columns computed over frames within ``before``/``after`` slots.

    ``build`` receives the window (partitioned, ordered by slot) and returns the
    new columns; its frames must be RANGE frames inside the stated bounds.
    """
    width = max(width, before + after, 1)
    lo = F.floor((F.col("slot") - after) / F.lit(width)).cast("bigint")
    hi = F.floor((F.col("slot") + before) / F.lit(width)).cast("bigint")
    spread = df.withColumn("_chunk", F.explode(F.sequence(lo, hi)))
    w = Window.partitionBy(*keys, "_chunk").orderBy("slot")
    return (
        spread.withColumns(build(w))
        .where(F.col("_chunk") == _chunk(width))
        .drop("_chunk")
    )


def with_neighbours(df: DataFrame, before: int, after: int = 0, width: int = WIDTH) -> DataFrame:
    """Rows with ``_chunk``, those near an edge also for the chunks that look ``before`` or
    ``after`` so far; ``_own`` marks a row in its own chunk. For functions of whole chunks."""
    width = max(width, before + after, 1)
    lo = F.floor((F.col("slot") - after) / F.lit(width)).cast("bigint")
    hi = F.floor((F.col("slot") + before) / F.lit(width)).cast("bigint")
    return df.withColumn("_chunk", F.explode(F.sequence(lo, hi))).withColumn("_own", F.col("_chunk") == _chunk(width))


def at_offset(w: WindowSpec, col: Column | str, offset: int) -> Column:
    """Value ``offset`` slots away (negative = earlier); NULL where no such slot."""
    return F.first(F.col(col) if isinstance(col, str) else col).over(
        w.rangeBetween(offset, offset)
    )


def nearest(df: DataFrame, keys: Sequence[str], cols: Sequence[str], width: int = WIDTH) -> DataFrame:
    """Nearest non-NULL value at or before (``_ff_<c>``) and at or after (``_bf_<c>``) each
    slot, as structs of the value ``v`` and the ``slot`` it comes from. Reads ``df`` twice."""
    keys, cols = list(keys), list(cols)
    cut = df.withColumn("_chunk", _chunk(width)).withColumns(
        {f"_e_{c}": F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("v"), "slot")) for c in cols}
    )
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("slot"))
    edges = cut.groupBy(*keys, "_chunk").agg(
        *[F.max_by(F.col(f"_e_{c}"), at(c)).alias(f"_last_{c}") for c in cols],
        *[F.min_by(F.col(f"_e_{c}"), at(c)).alias(f"_first_{c}") for c in cols],
    )
    # one row per chunk from here to the join
    by_key = Window.partitionBy(*keys).orderBy("_chunk")
    past = by_key.rowsBetween(Window.unboundedPreceding, -1)
    ahead = by_key.rowsBetween(1, Window.unboundedFollowing)
    flow = edges.select(
        *keys,
        "_chunk",
        *[F.last(f"_last_{c}", True).over(past).alias(f"_in_{c}") for c in cols],
        *[F.first(f"_first_{c}", True).over(ahead).alias(f"_next_{c}") for c in cols],
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy("slot")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to_come = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    local = cut.withColumns(
        {f"_l_{c}": F.last(f"_e_{c}", True).over(so_far) for c in cols}
        | {f"_f_{c}": F.first(f"_e_{c}", True).over(to_come) for c in cols}
    )
    return local.join(flow, [*keys, "_chunk"], "left").select(
        *df.columns,
        *[F.coalesce(f"_l_{c}", f"_in_{c}").alias(f"_ff_{c}") for c in cols],
        *[F.coalesce(f"_f_{c}", f"_next_{c}").alias(f"_bf_{c}") for c in cols],
    )


def fill_both_ways(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], width: int = WIDTH
) -> DataFrame:
    """Forward fill, then backward fill of the head, per key. Reads ``df`` twice."""
    keys, cols = list(keys), list(cols)
    cut = df.withColumn("_chunk", _chunk(width))
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("slot"))
    edges = cut.groupBy(*keys, "_chunk").agg(
        *[F.max_by(F.col(c), at(c)).alias(f"_last_{c}") for c in cols],
        *[F.min_by(F.col(c), at(c)).alias(f"_first_{c}") for c in cols],
    )
    # one row per chunk from here to the join
    by_key = Window.partitionBy(*keys).orderBy("_chunk")
    past = by_key.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_key.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    flow = edges.select(
        *keys,
        "_chunk",
        *[F.last(f"_last_{c}", True).over(past).alias(f"_in_{c}") for c in cols],
        *[F.first(f"_first_{c}", True).over(rest).alias(f"_next_{c}") for c in cols],
    )
    local = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy("slot")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = cut.withColumns({f"_loc_{c}": F.last(c, True).over(local) for c in cols})
    # a head without an earlier value takes the first one at or after its chunk
    return filled.join(flow, [*keys, "_chunk"], "left").select(
        *[
            F.coalesce(f"_loc_{c}", f"_in_{c}", f"_next_{c}").alias(c) if c in cols else F.col(c)
            for c in df.columns
        ]
    )


def runs(
    df: DataFrame,
    keys: Sequence[str],
    state: Column,
    keep: Column,
    width: int = WIDTH,
) -> DataFrame:
    """Maximal runs of consecutive slots with equal ``state`` where ``keep`` holds.

    Returns ``keys, state, start_slot, end_slot, n_slots``.
    """
    keys = list(keys)
    kept = (
        df.where(keep)
        .select(*keys, "slot", state.alias("state"))
        .withColumn("_chunk", _chunk(width))
    )
    w = Window.partitionBy(*keys, "_chunk").orderBy("slot")
    same = (F.lag("slot").over(w) == F.col("slot") - 1) & (
        F.lag("state").over(w).eqNullSafe(F.col("state"))
    )
    pieces = (
        kept.withColumn("_new", F.when(same, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_chunk", "_run")
        .agg(
            F.first("state").alias("state"),
            F.min("slot").alias("start_slot"),
            F.max("slot").alias("end_slot"),
        )
        .withColumn(
            "_edge",
            (F.col("start_slot") == F.col("_chunk") * width)
            | (F.col("end_slot") == F.col("_chunk") * width + (width - 1)),
        )
    )
    cols = [*keys, "state", "start_slot", "end_slot"]
    by_key = Window.partitionBy(*keys).orderBy("start_slot")
    joins = (F.lag("end_slot").over(by_key) == F.col("start_slot") - 1) & (
        F.lag("state").over(by_key).eqNullSafe(F.col("state"))
    )
    merged = (
        pieces.where("_edge")
        .withColumn("_new", F.when(joins, 0).otherwise(1))
        .withColumn("_run", F.sum("_new").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(
            F.first("state").alias("state"),
            F.min("start_slot").alias("start_slot"),
            F.max("end_slot").alias("end_slot"),
        )
        .select(*cols)
    )
    inner = pieces.where(~F.col("_edge")).select(*cols)
    return inner.unionByName(merged).withColumn(
        "n_slots", F.col("end_slot") - F.col("start_slot") + 1
    )


def row_ranks(
    df: DataFrame, keys: Sequence[str], rank: str = "rank", total: str = "n_rows", width: int = WIDTH
) -> DataFrame:
    """1-based rank by slot and row count per key, from per-chunk counts."""
    keys = list(keys)
    cut = df.withColumn("_chunk", _chunk(width))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_c"))
        .withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        .withColumn(total, F.sum("_c").over(by_key))
        .drop("_c")
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy("slot")
    return (
        cut.withColumn("_in", F.row_number().over(inside))
        .join(sizes, [*keys, "_chunk"])
        .withColumn(rank, F.col("_before") + F.col("_in"))
        .drop("_chunk", "_before", "_in")
    )
