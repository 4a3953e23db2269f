"""Packing documents into sequences: dominance reduction, then best fit.

The plan depends only on how many pieces have each length, at most ``capacity``
numbers however large the corpus is. It is made on the driver from that histogram,
and documents are dealt to its places by their rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stage import stage
from .subwords import encoder, tokenizer_path
from .text import text_batches

CAPACITY = 2048
END_ID = 0
#: Ranks are taken inside (length, lane), so that a length with many pieces is spread over tasks.
LANES = 256
#: Places are dealt to ranks in blocks of so many.
BLOCK = 1 << 15
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Token pieces of every document: whole documents with their end id, or pieces of
    ``capacity`` tokens of longer ones. Null texts count as empty and give one piece
    that holds the end id alone; null ids stay null; repeated rows are packed as often
    as they occur."""
    path = path or tokenizer_path()
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoder(path)
        for batch in batches:
            ids, at = code.encode(batch["text"].tolist())
            out = []
            for k, doc in enumerate(batch["doc_id"]):
                own = np.append(ids[at[k] : at[k + 1]], end_id).astype("<u4")
                for n, a in enumerate(range(0, len(own), capacity)):
                    part = own[a : a + capacity]
                    out.append((doc, n, a, len(part), zlib.crc32(part.tobytes())))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, PIECES)


# ---- the plan ------------------------------------------------------------


class _Stock:
    """Lengths that are left, with counts."""

    def __init__(self, counts: dict[int, int]):
        self.left = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.left)

    def take(self, size: int, n: int) -> None:
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def largest(self, room: int, spare: dict[int, int]) -> int:
        """Largest length within ``room`` of which more than ``spare`` are left, or 0."""
        k = bisect_left(self.sizes, room + 1) - 1
        while k >= 0 and self.left[self.sizes[k]] <= spare.get(self.sizes[k], 0):
            k -= 1
        return self.sizes[k] if k >= 0 else 0

    def smallest(self, n: int, spare: dict[int, int]) -> list[int]:
        """The ``n`` smallest items beside ``spare``."""
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(n - len(out), self.left[s] - spare.get(s, 0))
            if len(out) == n:
                break
        return out

    def best_pair(self, room: int, spare: dict[int, int]) -> tuple[int, int]:
        """Two items with the largest sum within ``room``, or zeros."""
        best, lo, hi = (0, 0), 0, bisect_left(self.sizes, room) - 1
        free = lambda s: self.left[s] - spare.get(s, 0)
        while 0 <= lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            if a + b > room or free(b) < 1:
                hi -= 1
            elif free(a) < 1 or a == b and free(a) < 2:
                lo += 1
            else:
                best = max(best, (b, a), key=sum)
                lo += 1
        return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Bins that some best packing holds, as (lengths, how many), and the counts left.

    For an item j, longest first, a set of at most three items with j in it is fixed
    when every other set that a bin with j could hold can be exchanged for it item by
    item (each item for one at least as long): the bin is filled exactly by j and one
    more; nothing fits beside j; nothing but one more fits, and the longest such is
    taken; or at most two more fit, and the longest one fitting weighs at least as much
    as the best two.
    """
    stock, fixed = _Stock(counts), []
    for size in sorted(counts, reverse=True):
        while stock.left.get(size):
            room, own = capacity - size, {size: 1}
            mate = stock.largest(room, own)
            if mate and mate < room:
                low = stock.smallest(3, own)
                pair_fits = len(low) >= 2 and low[0] + low[1] <= room
                if pair_fits and (len(low) == 3 and sum(low) <= room or mate < sum(stock.best_pair(room, own))):
                    break
            if not mate:
                n = stock.left[size]
                stock.take(size, n)
                fixed.append(((size,), n))
            elif mate == size:
                # the last one must stay apart: pairs of equal items use two each
                n = stock.left[size] // 2
                stock.take(size, 2 * n)
                fixed.append(((size, size), n))
            else:
                # what holds for one holds until either length runs out
                n = min(stock.left[size], stock.left[mate])
                stock.take(size, n)
                stock.take(mate, n)
                fixed.append(((size, mate), n))
    return fixed, stock.left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit of the items, longest first, over bins of equal content together."""
    rooms: list[int] = []  # rooms that occur, ascending
    open_: dict[int, list[list]] = defaultdict(list)  # room -> [contents, how many]

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        if not open_[room]:
            insort(rooms, room)
        open_[room].append([content, n])

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            k = bisect_left(rooms, size)
            if k == len(rooms):
                each = capacity // size
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * size, (size,) * each, full)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[k]
            content, m = open_[room].pop()
            if not open_[room]:
                rooms.pop(k)
            # the fullest bin takes items until it is closed to this length, as best fit would
            each = room // size
            bins = min(m, n // each) if n >= each else 0
            if bins:
                put(room - each * size, content + (size,) * each, bins)
                n -= bins * each
                if m > bins:
                    put(room, content, m - bins)
            else:
                put(room - n * size, content + (size,) * n, 1)
                if m > 1:
                    put(room, content, m - 1)
                n = 0
    return [(tuple(c), m) for groups in open_.values() for c, m in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> pd.DataFrame:
    """Places for ranks: pieces of ``length`` with ranks in [lo, hi) go to the sequence
    first + (rank - lo) div each, at offset + length * ((rank - lo) mod each)."""
    fixed, left = reduce_by_dominance(counts, capacity)
    used: dict[int, int] = defaultdict(int)
    out, first = [], 0
    for content, n in fixed + best_fit(left, capacity):
        offset, k = 0, 0
        while k < len(content):
            size, each = content[k], 1
            while k + each < len(content) and content[k + each] == size:
                each += 1
            out.append((size, used[size], used[size] + n * each, first, offset, each))
            used[size] += n * each
            offset += size * each
            k += each
        first += n
    return pd.DataFrame(out, columns=["length", "lo", "hi", "first", "offset", "each"])


# ---- dealing -------------------------------------------------------------


def deal(parts: DataFrame, capacity: int = CAPACITY, lanes: int = LANES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to stored pieces (read three times)."""
    spark = parts.sparkSession
    laned = parts.withColumn("lane", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(lanes)))
    per_lane = laned.groupBy("length", "lane").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_lane.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.createDataFrame(
        plan(counts, capacity), "length bigint, lo bigint, hi bigint, first bigint, offset bigint, each bigint"
    ).select(
        "*",
        F.explode(F.sequence(F.expr(f"lo div {BLOCK}"), F.expr(f"(hi - 1) div {BLOCK}"))).alias("block"),
    )
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_lane.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        laned.withColumn("at", F.row_number().over(own) - 1)
        .join(bases, ["length", "lane"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("at")).alias("rank"))
        .withColumn("block", F.expr(f"rank div {BLOCK}"))
    )
    # As-of join: in each (length, block) a piece takes the last place that begins at or before its rank.
    marks = places.select(
        "length", "block", F.greatest("lo", F.col("block") * BLOCK).alias("rank"), F.struct("lo", "first", "offset", "each").alias("place")
    )
    both = ranked.unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy("length", "block").orderBy("rank", F.col("place").isNull())
    step = F.col("rank") - F.col("at.lo")
    return (
        both.withColumn("at", F.last("place", ignorenulls=True).over(order))
        .where("place is null")
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("at.first") + F.floor(step / F.col("at.each"))).cast("bigint").alias("sequence_id"),
            (F.col("at.offset") + F.col("length") * (step % F.col("at.each"))).cast("bigint").alias("offset"),
        )
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece with its sequence and its place there. An empty table gives no rows."""
    return deal(stage(pieces(docs, capacity, end_id, path), "pieces"), capacity)


def fill(docs: DataFrame, packed: DataFrame, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """The sequences themselves: ``sequence_id``, ``ids`` and ``doc_of`` (which document
    each id belongs to). Needs unique document ids; rows without an id are left out."""
    path = path or tokenizer_path()
    text_batches(docs.sparkSession)

    def run(batches):
        code = encoder(path)
        for batch in batches:
            ids, at = code.encode(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [[*ids[a:b].tolist(), end_id] for a, b in zip(at, at[1:])]})

    ids = docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, "doc_id bigint, ids array<int>")
    part = ids.join(packed, "doc_id").select("sequence_id", F.struct("offset", F.expr("slice(ids, int(start) + 1, int(length))").alias("ids"), "doc_id").alias("p"))
    return part.groupBy("sequence_id").agg(F.array_sort(F.collect_list("p")).alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.flatten(F.transform("p", lambda x: F.array_repeat(x["doc_id"], F.size(x["ids"])))).alias("doc_of")
    )
