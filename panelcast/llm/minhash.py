"""Near-duplicates by circulant MinHash, verified on full shingle sets.

Two permutations of the 32-bit universe are enough for a signature: the first places
a shingle, the second, shifted circularly by k, gives coordinate k. Coordinates are
grouped into bands; documents that share a band are candidates, and a link is
confirmed on the two full sets. No bucket is turned into all its pairs: first every
member meets the bucket's most central member; what that leaves apart meets only where
the sets' rarest shingles allow the similarity asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import stage
from .components import stars
from .text import RowStore, lower_ascii, per_process, text_batches, words

WIDTH = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A pair at similarity 0.75 shares no band with probability (1 - 0.75**4)**32 = 5e-6.
ROWS, BANDS = 4, 32
CACHE_WORDS = 400_000
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of ``width`` words; of the
    whole sequence where there are fewer words; none without words."""
    known = per_process("shingles", "words", _WordHashes)
    if len(known) > CACHE_WORDS:
        known.clear()
    lists = [words(lower_ascii(t)) if t else [] for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.uint64, int(counts.sum()))
    ends = np.cumsum(counts)
    hashed = np.zeros(len(flat), np.uint64)
    with np.errstate(over="ignore"):
        n = max(len(flat) - width + 1, 0)
        for k in range(width):
            hashed[:n] = hashed[:n] * _P + flat[k : k + n]
        hashed = _mix64(hashed + np.uint64(width) * _P)
        out = []
        for m, end in zip(counts.tolist(), ends.tolist()):
            if m >= width:
                out.append(np.unique(hashed[end - m : end - width + 1]))
            elif m:
                h = np.zeros(1, np.uint64)
                for w in flat[end - m : end]:
                    h = h * _P + w
                out.append(_mix64(h + np.uint64(m) * _P))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """Circulant MinHash of non-empty sets, one row each."""
    out = np.empty((len(sets), coordinates), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    # first permutation: where a shingle stands in the universe of 2**32 places
    place = (_mix64(np.concatenate(sets)) >> np.uint64(32)).astype(np.uint32)
    x, y = np.empty_like(place), np.empty_like(place)
    for k in range(coordinates):
        # second permutation, shifted by k
        np.subtract(place, np.uint32(k), out=x)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            np.right_shift(x, np.uint32(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, np.uint32(factor), out=x)
        np.right_shift(x, np.uint32(16), out=y)
        np.bitwise_xor(x, y, out=x)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band; the band's number is part of it."""
    sig = signatures(sets, bands * rows).astype(np.uint64).reshape(len(sets), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2]).copy()
    for r in range(rows):
        key = _mix64(key * _P + sig[:, :, r])
    return key.view(np.int64)


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _describe(own: DataFrame, bands: int, rows: int, width: int) -> DataFrame:
    """doc_id, row_key, node (names the shingle set; null if it is empty), n, keys, and where
    the row stands, if ``own`` tells."""
    at = [c for c in ("file", "row") if c in own.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), width)
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(full, bands, rows).tolist() if full else [])
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "row_key": batch["row_key"],
                    "node": [set_key(s) if len(s) else None for s in sets],
                    "n": [len(s) for s in sets],
                    "keys": [next(keys) if len(s) else None for s in sets],
                    **{c: batch[c] for c in at},
                }
            )

    kind = "doc_id bigint, row_key bigint, node binary, n bigint, keys array<bigint>"
    return own.mapInPandas(run, kind + "".join(f", {c} {own.schema[c].dataType.simpleString()}" for c in at))


def _sets(own: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, n and full set of the documents whose row key is wanted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [s for s in shingle_sets(batch["text"].tolist(), width) if len(s)]
            yield pd.DataFrame({"node": [set_key(s) for s in sets], "items": [s.view(np.int64) for s in sets]})

    found = own.join(wanted, "row_key", "left_semi").select("text").mapInPandas(run, "node binary, items array<bigint>")
    return found.groupBy("node").agg(F.first("items").alias("items"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among candidate pairs (a, b), by the full sets."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    sized = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("i"), (F.size("x") + F.size("y")).alias("s"))
    return sized.where(100 * F.col("i") >= percent * (F.col("s") - F.col("i"))).select(F.col("a").alias("hi"), F.col("b").alias("lo"))


def _prefix_pairs(left: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different parts that share a bucket and may be similar enough.

    Shingles are put in one order for all sets, widespread ones last. If two sets are as
    similar as asked, the first shingle that they share comes so early in both that what
    follows it can still make up the overlap; pairs are met at such shingles only. Edits
    of one text are told apart by what each has of its own, however many they are. Nothing
    is lost: the order decides the cost, not the result.
    """
    flat = left.select("node", F.explode("items").alias("item"))
    spread = flat.groupBy("item").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    # a shingle of one set alone can't be shared, but it takes its place in the order
    placed = flat.join(spread, "item", "left").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "item"))).alias("order")
    )
    early = left.select("node", "part", "keys", F.size("items").alias("n")).join(placed, "node")
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    early = early.select("node", "part", "n", "keys", F.posexplode(F.slice("order", F.lit(1), reach.cast("int"))).alias("pos", "o")).where("o.df > 1")
    x = early.select(F.col("o.item").alias("item"), F.col("node").alias("u"), F.col("part").alias("p"), F.col("n").alias("nu"), F.col("pos").alias("iu"), F.col("keys").alias("ku"))
    y = early.select(F.col("o.item").alias("item"), F.col("node").alias("v"), F.col("part").alias("q"), F.col("n").alias("nv"), F.col("pos").alias("iv"), F.col("keys").alias("kv"))
    # overlap still possible from this shingle on, against the overlap needed
    reachable = F.least(F.col("nu") - F.col("iu"), F.col("nv") - F.col("iv")) * (100 + percent) >= percent * (F.col("nu") + F.col("nv"))
    near = (F.col("u") < F.col("v")) & (F.col("p") != F.col("q")) & reachable & _near_size("nu", "nv", percent) & F.arrays_overlap("ku", "kv")
    return x.join(y, (x["item"] == y["item"]) & near).select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()


def _paired(one: str, other: str):
    return F.least(one, other).alias("a"), F.greatest(one, other).alias("b")


def _near_size(one: str, other: str, percent: int):
    """Sets whose sizes differ more can't be as similar."""
    return 100 * F.least(one, other) >= percent * F.greatest(one, other)


def _components(own: DataFrame, width: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """What is told of each row (:func:`_describe`), and the part (component) of each node
    with the smallest id that the node's rows have. ``own`` has doc_id, text and row_key."""
    text_batches(own.sparkSession)
    told = stage(_describe(own, bands, rows, width), "minhash")
    # equal sets are one node from here on
    nodes = told.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("keys").alias("keys")
    )
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = stage(keyed.join(shared, "key"), "buckets")
    central = shared.groupBy("node").agg(F.sum("members").alias("weight"))
    central = stage(central.join(nodes.select("node", "n", "row_key"), "node"), "central")
    sets = stage(_sets(own, central.select("row_key"), width), "sets")

    # Leaders: each member meets its bucket's most central one.
    weighed = shared.select("key", "node").join(central.select("node", "n", "weight"), "node")
    leaders = weighed.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("top"))
    led = stage(weighed.join(leaders, "key").where("node != top.node").select("key", "node", "n", "top"), "led")
    met = led.where(_near_size("n", "top.n", percent))
    tried = stage(met.select(*_paired("node", "top.node")).distinct(), "pairs")
    links = stage(_confirm(tried, sets, percent), "links")

    # What is linked to the same hub is one part. Buckets that hold several parts beside
    # their leader, which has met all, are looked through.
    ends = links.select(F.col("hi").alias("node"), F.col("lo").alias("other")).union(links.select("lo", "hi"))
    hubs = ends.join(central.select(F.col("node").alias("other"), "weight"), "other").groupBy("node").agg(F.max(F.struct("weight", "other")).alias("hub"))
    part = F.when(F.struct("hub.weight", "hub.other") > F.struct("weight", "node"), F.col("hub.other")).otherwise(F.col("node"))
    parts = stage(central.join(hubs, "node", "left").select("node", part.alias("part")), "parts")
    labelled = led.select("key", "node").join(parts, "node")
    mixed = labelled.groupBy("key").agg(F.min("part").alias("one"), F.max("part").alias("other")).where("one != other")
    left = labelled.join(mixed.select("key"), "key").groupBy("node", "part").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    left = stage(left.join(sets, "node"), "left")
    fresh = stage(_prefix_pairs(left, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    forest = stars(links.union(_confirm(fresh, sets, percent)))

    parts = nodes.select("node", "doc_id").join(forest.withColumnRenamed("hi", "node"), "node", "left")
    return told, parts.select("node", "doc_id", F.coalesce("lo", "node").alias("part"))


def _own(docs: DataFrame, *more: str) -> DataFrame:
    # one frame for both readers, as the key of a row depends on the types
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    return own.withColumn("row_key", F.xxhash64("doc_id", "text"))


def near_duplicates(
    docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents without words (null, empty or white text) have an empty set and are
    linked with nothing. Very long texts are compared whole. Null ids are never a
    component's smallest id; a component of null ids alone has a null component_id and
    keeps its rows. Repeated rows are linked like any copies; rows that share the smallest
    id are all kept. An empty table gives no rows. Other columns are not read, so their
    names do not matter.
    """
    told, parts = _components(_own(docs), width, percent, bands, rows)
    least = parts.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    of = parts.join(least, "part").select("node", "component_id")
    out = told.select("doc_id", "node", F.col("n").alias("n_shingles")).join(of, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )


def drop_near_copies(
    docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: one row of each component, and every row
    without words.

    Of a component the row with the smallest id stays (null ids last, then the first place
    in the stored rows). Rows are told apart by where they are stored, not by id: another
    text under the same id, or under a null id, is judged by itself. Columns may have any
    names. An empty table gives no rows.
    """
    store = RowStore(docs, "near")
    told, parts = _components(_own(store.rows(), "file", "row"), width, percent, bands, rows)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "file", "row")
    # rows of one node, then nodes of one part, so that no join meets a large group
    best = told.where("node is not null").groupBy("node").agg(F.min(place).alias("best"))
    best = best.join(parts.select("node", "part"), "node").groupBy("part").agg(F.min("best").alias("best"))
    wordless = told.where("node is null").select("file", "row")
    return store.keep(wordless.union(best.select("best.file", "best.row")))
