"""Exact k-means over integer vectors by Shallot search.

Each vector remembers its nearest and its second-nearest centroid, an upper bound of its
distance to the former and a lower bound of its distance to all others. Bounds are moved
along with the centroids; where they prove that the nearest centroid is the same, nothing
is measured. Other vectors measure the two centroids they remember, start from the
closer one, and walk through that centroid's neighbours in order of distance. The walk
ends where a neighbour is farther from the start than the distance to the start plus the
distance to the second nearest found so far: a ball that shrinks while the walk goes on.
Bounds are floating-point numbers with a margin; what they leave over is compared in
integers.

Vectors with their bounds are a stored table, rewritten each round; sums come from
tasks as one row a centroid. The driver holds centroids only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stage import stage

COMPONENTS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 16, 3, 64, 1
#: Floating-point bounds give way by this share.
MARGIN = 1e-9
STATE = "vec_id bigint, v array<bigint>, near int, second int, upper double, lower double, distance bigint"


def integer_vectors(table: DataFrame, column: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the kept vectors as integers: those with exactly ``components``
    components, none null, not a number or infinite, or too large for 64 bits when scaled."""
    x = F.col(f"`{column}`")
    fits = lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) < 2.0**63)  # noqa: E731  also false for NaN and infinity
    kept = table.where(F.coalesce((F.size(x) == components) & F.forall(x, lambda c: F.coalesce(fits(c), F.lit(False))), F.lit(False)))
    return kept.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))


def _hash(vec_id: Column, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(vec_id.cast("string"), F.lit("")))
    return F.sha2(text.cast("binary"), 256)


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The k vectors with the smallest digests of ``seed:vec_id``; equal ids by components."""
    rows = vectors.select(_hash(F.col("vec_id"), seed).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [list(r["v"]) for r in rows]


def narrow(components: int) -> int:
    """Integers up to this size are measured in 64 bits; larger ones as Python's integers."""
    return math.isqrt((1 << 62) // components) // 2


class Centroids:
    """Centroids of a round, what is between them, and how far they moved."""

    def __init__(self, rows: list[list[int]], before: list[list[int]] | None):
        self.wide = max((abs(x) for r in rows for x in r), default=0) > narrow(len(rows[0]))
        self.c = np.array(rows, dtype=object if self.wide else np.int64)
        apart = np.array([[math.dist(a, b) for b in rows] for a in rows]).reshape(len(rows), len(rows))
        np.fill_diagonal(apart, np.inf)
        self.order = np.argsort(apart, axis=1, kind="stable")[:, : len(rows) - 1]
        self.gaps = np.take_along_axis(apart, self.order, axis=1)
        self.half = apart.min(axis=1, initial=np.inf) / 2
        moved = np.zeros(len(rows)) if before is None else np.array([math.dist(a, b) for a, b in zip(before, rows)])
        self.moved = moved
        # farthest that any other centroid moved
        top = np.sort(moved)[::-1]
        self.others_moved = np.where(moved == top[0], top[1] if len(rows) > 1 else 0.0, top[0])
        if (moved == top[0]).sum() > 1:
            self.others_moved[:] = top[0]

    def squared(self, x: np.ndarray, which) -> np.ndarray:
        c = self.c[which]
        if self.wide != (x.dtype == object):
            x, c = x.astype(object), c.astype(object)
        return ((x - c) ** 2).sum(axis=1)


def _root(squared: np.ndarray) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64))


def assign_batch(x: np.ndarray, near, second, upper, lower, centroids: Centroids) -> tuple:
    """New (near, second, upper, lower) of vectors ``x`` and how many distances were measured."""
    k = len(centroids.c)
    near, second = near.copy(), second.copy()
    upper = (upper + centroids.moved[near]) * (1 + MARGIN)
    lower = np.maximum(lower - centroids.others_moved[near], 0) * (1 - MARGIN)
    if k == 1:
        return near, second, upper, lower, 0
    measured = 0
    bound = lambda: np.maximum(lower, centroids.half[near] * (1 - MARGIN))
    left = np.flatnonzero(~(upper < bound()))
    if len(left):  # measure the nearest so far, then look again
        upper[left] = _root(centroids.squared(x[left], near[left])) * (1 + MARGIN)
        measured += len(left)
        left = left[~(upper[left] < bound()[left])]
    if not len(left):
        return near, second, upper, lower, measured
    own = x[left]
    a, b = near[left], second[left]
    da, db = centroids.squared(own, a), centroids.squared(own, b)
    measured += len(left)  # the distance to ``a`` was measured above
    swap = (db < da) | ((db == da) & (b < a))
    a, b, da, db = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, db, da), np.where(swap, da, db)
    start, reach = a.copy(), _root(da)
    rows = np.arange(len(left))
    for step in range(k - 1):
        # the ball: the start's distance plus the second-nearest distance as it is now
        inside = centroids.gaps[start[rows], step] <= (reach[rows] + _root(db[rows])) * (1 + MARGIN)
        rows = rows[inside]  # gaps rise and the ball shrinks: who leaves stays out
        if not len(rows):
            break
        j = centroids.order[start[rows], step]
        new = (j != a[rows]) & (j != b[rows])
        at, j = rows[new], j[new]
        if not len(at):
            continue
        d = centroids.squared(own[at], j)
        measured += len(at)
        first = (d < da[at]) | ((d == da[at]) & (j < a[at]))
        next_ = ~first & ((d < db[at]) | ((d == db[at]) & (j < b[at])))
        f, n = at[first], at[next_]
        b[f], db[f] = a[f], da[f]
        a[f], da[f] = j[first], d[first]
        b[n], db[n] = j[next_], d[next_]
    near[left], second[left] = a, b
    upper[left], lower[left] = _root(da) * (1 + MARGIN), _root(db) * (1 - MARGIN)
    return near, second, upper, lower, measured


def _matrix(column: pa.Array, components: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
    return x.astype(object) if len(x) and max(-int(x.min()), int(x.max())) > narrow(components) else x


def _round(rows: list[list[int]], before: list[list[int]] | None, exact: bool):
    """A task's work in one round; with ``exact``, distances are filled in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = Centroids(rows, before)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), len(rows[0]))
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            near, second, upper, lower, _ = assign_batch(x, get("near"), get("second"), get("upper"), get("lower"), centroids)
            distance = pa.nulls(batch.num_rows, pa.int64())
            if exact:
                d = centroids.squared(x, near)
                distance = pa.array([int(v) if v < 2**63 else None for v in d] if d.dtype == object else d, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"), pa.array(near, pa.int32()), pa.array(second, pa.int32()), pa.array(upper), pa.array(lower), distance],
                names=["vec_id", "v", "near", "second", "upper", "lower", "distance"],
            )

    return run


def _sums(components: int):
    """A task's sums: one row a centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"), components)
            near = batch.column("near").to_numpy()
            order = np.argsort(near, kind="stable")
            which, at = np.unique(near[order], return_index=True)
            sums = np.add.reduceat(x[order], at, axis=0)
            for c, s, n in zip(which.tolist(), sums.tolist(), np.diff([*at, len(near)]).tolist()):
                own = total.setdefault(c, [0, [0] * components])
                own[0] += n
                own[1] = [p + q for p, q in zip(own[1], s)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()),
                pa.array([[str(q) for q in s] for _, s in total.values()], pa.list_(pa.string())),
            ],
            names=["near", "n", "sums"],
        )

    return run


def _moved(state: DataFrame, rows: list[list[int]]) -> list[list[int]]:
    """Centroids at floor(sum / count) of their vectors; those without any stay."""
    m = len(rows[0])
    parts = state.select("v", "near").mapInArrow(_sums(m), "near int, n bigint, sums array<string>")
    sums = F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(m)])
    out = list(rows)
    for r in parts.groupBy("near").agg(F.sum("n").alias("n"), sums.alias("sums")).collect():  # a row a centroid
        out[r["near"]] = [int(s) // r["n"] for s in r["sums"]]
    return out


def cluster(table: DataFrame, column: str = "embedding", components: int = COMPONENTS, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia,
    inertia, centroid_sha256, and second (number of the second-nearest centroid seen).

    Vectors of another length, with a null, NaN or infinite component, or with one that
    scaled does not fit 64 bits are left out, as are null vectors. With fewer than k kept
    vectors each is a centroid; with none the result is empty. Ties go to the smaller
    number, so of equal first centroids the later ones stay empty. Repeated rows, repeated
    ids and null ids (hashed as an empty id) are vectors of their own; equal ids are
    taken in the order of their components. Distances and sums that do not fit a long are
    null. Other columns are not read, so their names do not matter.
    """
    spark = table.sparkSession
    kind = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, second int"
    vectors = integer_vectors(table, column, components, scale)
    rows = first_centroids(vectors, k, seed)
    if not rows:
        return spark.createDataFrame([], kind)
    # Nothing is known yet: the nearest may be any, the second another.
    other = min(1, len(rows) - 1)
    state = vectors.select("*", F.lit(0).alias("near"), F.lit(other).alias("second"), F.lit(math.inf).alias("upper"), F.lit(0.0).alias("lower"), F.lit(None).cast("bigint").alias("distance"))
    before = None
    for _ in range(rounds):
        state = stage(state.mapInArrow(_round(rows, before, False), STATE), "vectors")
        before, rows = rows, _moved(state, rows)
    state = stage(state.mapInArrow(_round(rows, before, True), STATE), "vectors")
    inertia = {r["near"]: r["s"] for r in state.groupBy("near").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.count("distance").alias("n"), F.count("*").alias("m")).where("n = m").collect()}
    held = state.select("near").distinct().collect()
    whole = sum(inertia.values()) if len(inertia) == len(held) else None
    longs = lambda s: F.lit(int(s) if s is not None and s < 2**63 else None).cast("bigint")
    digests = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in rows]
    per = lambda values: F.array(*values)[F.col("near")]
    return state.select(
        "vec_id", F.col("near").alias("cluster"), "distance", per([longs(inertia.get(i)) for i in range(len(rows))]).alias("cluster_inertia"),
        longs(whole).alias("inertia"), per([F.lit(d) for d in digests]).alias("centroid_sha256"), "second",
    )
