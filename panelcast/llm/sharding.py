"""Shards of near equal size by minimax contiguous partition.

Equal texts form groups that are never cut. Groups stand in the order of their smallest
id, and shards are runs of groups. The smallest capacity that lets ``shards`` runs hold
everything is found by binary search, where each capacity is checked greedily: fill a
run as far as the capacity goes, then begin the next one.

A check needs only one question answered: which is the last group that ends at or before
a given byte? The ends of all groups stay in a stored table. The driver holds a fixed
number of bins over them, each with its first and last end, so an answer is exact
between bins and an interval inside one. The search goes on with intervals, and where
they leave the capacity or a cut open, the few bins concerned are split by another
aggregation. Each pass makes open bins 256 times narrower, so six passes do for 10^14
bytes.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stage import stage

SHARDS = 16
#: Bins of the first pass, and bins into which a later pass splits each open stretch.
FIRST_BINS, BINS = 4096, 256
#: Rows of one text are ranked in so many lanes (two hex digits of a digest of the id).
LANE_DIGITS = 2


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of the text and one more for its end."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def _items(docs: DataFrame) -> DataFrame:
    """One row per distinct (id, text): digest, size, crc, and how often it occurs."""
    own = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    raw = F.col("text").cast("binary")
    lane = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, LANE_DIGITS)
    out = own.select("doc_id", F.sha2(raw, 256).alias("digest"), byte_size(F.col("text")).alias("size"), F.crc32(raw).alias("text_crc32"), lane.alias("lane"))
    return out.groupBy("digest", "lane", "doc_id").agg(F.max("size").alias("size"), F.max("text_crc32").alias("text_crc32"), F.count("*").alias("copies"))


def _ends(items: DataFrame) -> DataFrame:
    """Groups in order with the bytes and rows up to their end. The order is cut into
    ranges, running sums are taken inside each, and only the ranges' totals are summed
    across them."""
    groups = items.groupBy("digest").agg(
        F.min("doc_id").alias("head"), F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("size")).alias("bytes")
    )
    order = [F.col("head").asc_nulls_last(), F.col("digest")]
    cut = stage(groups.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "shard-groups")
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("part").agg(F.sum("n").alias("tn"), F.sum("bytes").alias("tb"))
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    totals = totals.select("part", zero("tn").alias("n0"), zero("tb").alias("b0"))
    runs = cut.select("digest", "part", "n", F.sum("bytes").over(inside).alias("b"), F.sum("n").over(inside).alias("r"))
    out = runs.join(totals, "part").select("digest", "n", (F.col("b0") + F.col("b")).alias("end"), (F.col("n0") + F.col("r")).alias("end_row"))
    return stage(out, "shard-ends")


@dataclass
class Ends:
    """What the driver knows of the stored ends: disjoint bins in order, each with its
    first and last end and how many distinct ends it has."""

    table: DataFrame
    first: list[int] = field(default_factory=lambda: [0])
    last: list[int] = field(default_factory=lambda: [0])
    open: list[bool] = field(default_factory=lambda: [False])

    def at_most(self, x: int) -> tuple[int, int]:
        """Bounds of the largest end that is ``x`` or less."""
        i = bisect.bisect_right(self.first, x) - 1
        if i < 0:
            return 0, 0
        if x >= self.last[i]:
            return self.last[i], self.last[i]
        return self.first[i], x if self.open[i] else self.first[i]

    def at_least(self, x: int) -> tuple[int, int]:
        """Bounds of the smallest end that is ``x`` or more."""
        i = bisect.bisect_left(self.last, x)
        if x <= self.first[i]:
            return self.first[i], self.first[i]
        return x if self.open[i] else self.last[i], self.last[i]

    def split(self, stretches: list[tuple[int, int, int]]) -> None:
        """Learn (low, high, width): the ends from low to high in bins of ``width``."""
        end = F.col("end")
        inside = [end.between(low, high) for low, high, _ in stretches]
        start = F.when(F.lit(False), F.lit(0).cast("bigint"))
        for here, (low, _, width) in zip(inside, stretches):  # one flat CASE
            start = start.when(here, end - (end - low) % width)
        wanted = self.table.where(reduce(Column.__or__, inside)).select("end", start.alias("start"))
        found = wanted.groupBy("start").agg(F.min("end").alias("a"), F.max("end").alias("z"), F.count("*").alias("n")).collect()
        news = [(r["a"], r["z"], r["n"] > 2) for r in found]
        olds = [b for b in zip(self.first, self.last, self.open) if not any(low <= b[0] and b[1] <= high for low, high, _ in stretches)]
        rows = sorted(olds + news)
        self.first, self.last, self.open = ([r[i] for r in rows] for i in range(3))

    def bin_of(self, x: int) -> tuple[int, int] | None:
        """The open bin that leaves a question about ``x`` unanswered."""
        i = bisect.bisect_right(self.first, x) - 1
        return (self.first[i], self.last[i]) if i >= 0 and self.open[i] and x < self.last[i] else None


def _greedy(ends: Ends, capacity: int, shards: int, total: int, unsure: set) -> bool | None:
    """Whether ``shards`` runs of at most ``capacity`` hold all; None where the bins leave
    it open, whose bins are then added to ``unsure``."""
    low = high = 0
    asked = []
    for _ in range(shards):
        asked += [ends.bin_of(low + capacity), ends.bin_of(high + capacity)]
        low, high = ends.at_most(low + capacity)[0], ends.at_most(high + capacity)[1]
        if low >= total:
            return True
    if high < total:
        return False
    unsure.update(b for b in asked if b)
    return None


def _cuts(ends: Ends, capacity: int, shards: int, total: int, unsure: set) -> list[int]:
    """Ends of the runs, each as near to an equal share of what is left as the capacity
    allows it and those after it. Bins that leave a cut open are added to ``unsure``."""

    def ask(answer: tuple[int, int], x: int) -> int:
        if answer[0] != answer[1]:
            unsure.add(ends.bin_of(x))
        return answer[0]

    least = [total] * (shards + 1)  # least[k]: where run k must have ended for the others to hold the rest
    for k in range(shards - 1, 0, -1):
        x = max(least[k + 1] - capacity, 0)
        least[k] = ask(ends.at_least(x), x) if x else 0
    cuts, at = [], 0
    for k in range(1, shards):
        aim = at + -(-(total - at) // (shards - k + 1))
        most = ask(ends.at_most(at + capacity), at + capacity)
        below, above = ask(ends.at_most(aim), aim), ask(ends.at_least(aim), aim)
        near = below if aim - below <= above - aim else above
        at = max(min(max(near, least[k]), most), at)
        cuts.append(at)
    return cuts


def _width(low: int, high: int, bins: int) -> int:
    return max(1, -(-(high - low + 1) // bins))


def minimax_cuts(ends: Ends, total: int, shards: int = SHARDS, first_bins: int = FIRST_BINS, bins: int = BINS) -> tuple[int, list[int], int]:
    """Smallest capacity, the ends of all runs but the last, and the number of passes
    over the table of ends, of which ``total`` is the last."""
    if not total:
        return 0, [0] * (shards - 1), 0
    passes = 1
    ends.split([(1, total, _width(1, total, first_bins))])
    low, high = -(-total // shards), total  # capacities: below low none will do, high does
    while True:
        unsure: set = set()
        below, above = low, high
        while below < above:  # smallest capacity that surely does
            mid = (below + above) // 2
            below, above = (below, mid) if _greedy(ends, mid, shards, total, unsure) else (mid + 1, above)
        high, unsure = below, set()
        below, above = low, high
        while below < above:  # smallest that is not surely too small
            mid = (below + above) // 2
            below, above = (mid + 1, above) if _greedy(ends, mid, shards, total, set()) is False else (below, mid)
        low = below
        if low == high:
            cuts = _cuts(ends, high, shards, total, unsure)
        else:
            _greedy(ends, low, shards, total, unsure)
            _greedy(ends, (low + high) // 2, shards, total, unsure)
        if not unsure:
            return high, cuts, passes
        ends.split([(a, z, _width(a, z, bins)) for a, z in sorted(unsure)])
        passes += 1


def assign(docs: DataFrame, shards: int = SHARDS, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law (``bytes``), shard, slot,
    grown_shard (null), and group_bytes (size of the row's group of equal texts).

    Equal texts share a shard; no shard is larger than the smallest largest shard that
    runs of groups, in the order of their smallest ids, can have. Null and empty texts
    are equal, of size 1. Texts are equal if their SHA-256 is. Inside a shard, groups
    stand in their order and rows of one text by digest of the id, then id; null ids
    come first there, and groups of null ids alone come last. Repeated rows take slots
    of their own. Very long texts are rows like others. A table without rows gives none;
    with fewer groups than shards some shards stay empty. Other columns are not read, so
    their names do not matter.
    """
    items = stage(_items(docs), "shard-items")
    ends = _ends(items)
    total = ends.agg(F.max("end")).first()[0] or 0
    _, cuts, _ = minimax_cuts(Ends(ends), total, shards, **options)
    shard = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    placed = ends.select("digest", shard.alias("shard"), (F.col("end_row") - F.col("n")).alias("row"), "n")
    heads = placed.groupBy("shard").agg(F.min("row").alias("head")).collect()  # a row a shard
    head = F.element_at(F.create_map(*[F.lit(x) for r in heads for x in (r["shard"], r["head"])]), F.col("shard")) if heads else F.lit(0)
    # Lanes of a text: at most 16^LANE_DIGITS rows, so that a text of many rows is ranked in pieces.
    lanes = items.groupBy("digest", "lane").agg(F.sum("copies").alias("rows"))
    before = Window.partitionBy("digest").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.join(placed, "digest").select(
        "digest", "lane", "shard", "n", (F.col("row") - head + F.coalesce(F.sum("rows").over(before), F.lit(0))).alias("start")
    )
    inside = Window.partitionBy("digest", "lane").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    out = items.withColumn("earlier", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(lanes, ["digest", "lane"])
    # Repeats of one row come out in two steps, so that no list is long.
    step = 4096
    out = out.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / step))))
    last = F.least(F.col("copies") - F.col("chunk") * step, F.lit(step)) - 1
    out = out.withColumn("again", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    slot = F.col("start") + F.col("earlier") + F.col("chunk") * step + F.col("again")
    return out.select(
        "doc_id", "size", F.col("text_crc32").cast("bigint").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        slot.cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), (F.col("n") * F.col("size")).alias("group_bytes"),
    )
