import hashlib
import math
import random

import numpy as np
from llm_frames import CLASHING, FILL
from panelcast.llm import centroids

WIDE = "vec_id bigint, embedding array<double>, " + CLASHING


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, *FILL) for i, v in rows], WIDE)


def brute(rows, components, k, rounds):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == components and all(x is not None and math.isfinite(x) and abs(64 * x) < 2**63 for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        own = [[] for _ in cents]
        for _, v in kept:
            own[near(v)[1]].append(v)
        cents = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(own, cents)]
    got = [(i, *near(v)) for i, v in kept]
    inertia = [sum(d for _, d, c in got if c == j) for j in range(len(cents))]
    long = lambda x: x if x < 2**63 else None
    null = [any(c == j and d >= 2**63 for _, d, c in got) for j in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    whole = None if any(null) else long(sum(inertia))
    return sorted(map(str, [(i, c, long(d), None if null[c] else long(inertia[c]), whole, sha[c]) for i, d, c in got]))


def result(df):
    return sorted(str(tuple(r)) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def some(rng, n, components):
    heads = [[rng.uniform(-2, 2) for _ in range(components)] for _ in range(9)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(heads)]) for i in range(n)]


def test_against_all_distances(spark):
    rng = random.Random(4)
    rows = some(rng, 150, 5)
    rows += [(1000 + i, list(rows[0][1])) for i in range(40)]  # copies
    rows += [(2000 + i, [float(rng.randrange(-1, 2)) / 64 for _ in range(5)]) for i in range(60)]  # ties
    bad = [(1, None), (2, []), (3, [1.0] * 4), (4, [1.0] * 6), (5, [1.0, None, 1.0, 1.0, 1.0]), (6, [float("nan")] + [0.0] * 4), (7, [float("inf")] + [0.0] * 4), (8, [2.0**58] + [0.0] * 4)]
    rows += bad + [(None, [0.5] * 5), (None, [0.25] * 5), (10, [0.1] * 5), (10, [0.1] * 5), (11, [-0.0, -1e-9, 1 / 64, -1 / 64, 0.99999 / 64])]
    want = brute(rows, 5, 7, 3)
    for parts in (1, 7):
        assert result(centroids.cluster(vectors(spark, rows).repartition(parts), components=5, k=7)) == want


def test_components_beyond_64_bit_squares(spark):
    rows = some(random.Random(8), 30, 3) + [(500, [1e9, 0.0, 0.0]), (501, [-1e9, 1e10, 0.0]), (502, [1e6, 1e6, 1e6]), (503, [9e16, 0.0, 9e16])]
    for k in (3, 34):
        assert result(centroids.cluster(vectors(spark, rows), components=3, k=k, rounds=2)) == brute(rows, 3, k, 2)


def test_few_and_no_vectors(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [3.0, 0.0])]):
        assert result(centroids.cluster(vectors(spark, rows), components=2, k=4)) == brute(rows, 2, 4, 3)


def test_bounds_save_distances_and_the_ball_holds():
    rng = np.random.default_rng(3)
    heads = rng.integers(-400, 400, (40, 6))
    x = heads[rng.integers(0, 40, 3000)] + rng.integers(-30, 30, (3000, 6))
    rows = [r.tolist() for r in x[:40]]
    near, second = np.zeros(3000, int), np.ones(3000, int)
    upper, lower, before, counts = np.full(3000, np.inf), np.zeros(3000), None, []
    for _ in range(6):
        c = centroids.Centroids(rows, before)
        near, second, upper, lower, n = centroids.assign_batch(x, near, second, upper, lower, c)
        every = ((x[:, None, :] - np.array(rows)[None]) ** 2).sum(axis=2)
        assert (near == every.argmin(axis=1)).all()
        true = np.sqrt(every)
        rest = true.copy()
        rest[np.arange(3000), near] = np.inf
        assert (upper >= true[np.arange(3000), near]).all() and (lower <= rest.min(axis=1)).all()
        counts.append(n)
        before, rows = rows, [(x[near == j].sum(axis=0) // (near == j).sum()).tolist() if (near == j).any() else rows[j] for j in range(40)]
    assert counts[0] < 0.8 * 3000 * 40  # the ball
    assert counts[-1] < 0.1 * counts[0]  # the bounds
