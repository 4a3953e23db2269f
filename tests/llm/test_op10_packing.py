import random
from itertools import combinations

import numpy as np

from llm_frames import MESSY, documents
from panelcast.llm import packing
from test_op4_tokenfiles import ids_of


def optimum(items, capacity):
    """Fewest bins, by search over sets of items."""
    items = sorted(items, reverse=True)
    memo = {}

    def need(left):
        if not left:
            return 0
        if left not in memo:
            head, rest, best = left[0], left[1:], len(left)
            for k in range(len(rest) + 1):
                for c in combinations(range(len(rest)), k):
                    if head + sum(rest[i] for i in c) <= capacity:
                        best = min(best, 1 + need(tuple(x for i, x in enumerate(rest) if i not in c)))
            memo[left] = best
        return memo[left]

    return need(tuple(items))


def histogram(items):
    sizes, counts = np.unique(items, return_counts=True)
    return dict(zip(sizes.tolist(), counts.tolist()))


def test_fixed_sets_keep_the_optimum():
    rng = random.Random(5)
    for _ in range(150):
        capacity = rng.choice([10, 13, 20])
        items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))]
        fixed, left = packing.reduce_by_dominance(histogram(items), capacity)
        rest = [s for s, n in left.items() for _ in range(n)]
        packed = [s for content, n in fixed for _ in range(n) for s in content]
        assert sorted(packed + rest) == sorted(items)
        assert all(sum(c) <= capacity for c, _ in fixed)
        assert sum(n for _, n in fixed) + optimum(rest, capacity) == optimum(items, capacity)


def test_best_fit_is_that_of_single_items():
    rng = random.Random(6)
    for _ in range(100):
        items = [rng.randrange(1, 50) for _ in range(rng.randrange(1, 80))]
        rooms = []
        for s in sorted(items, reverse=True):
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - s)
            else:
                rooms.append(50 - s)
        bins = packing.best_fit(histogram(items), 50)
        assert sorted(50 - sum(c) for c, n in bins for _ in range(n)) == sorted(rooms)
        assert sorted(s for c, n in bins for _ in range(n) for s in c) == sorted(items)


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_pack_and_fill(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["word"] * rng.choice([1, 5, 5, 5, 17, 40, 90, 130]))) for i in range(400)]
    df = documents(spark, rows)
    out = packing.pack(df, capacity=64, end_id=0)
    got = out.collect()
    n = check(got, 64)
    total = sum(r["length"] for r in got)
    assert n <= 1.1 * (-(-total // 64)) + 1
    ids = dict(zip([d for d, _ in rows], ids_of([t for _, t in rows], 0)))
    whole = {d: [] for d in ids}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == sum(whole[r["doc_id"]]) and (r["length"] == 64 or r["start"] + r["length"] == len(ids[r["doc_id"]]))
        whole[r["doc_id"]].append(r["length"])
    filled = {r["sequence_id"]: r for r in packing.fill(df, out, end_id=0).collect()}
    for r in got:
        s = filled[r["sequence_id"]]
        assert s["ids"][r["offset"] : r["offset"] + r["length"]] == ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert set(s["doc_of"][r["offset"] : r["offset"] + r["length"]]) == {r["doc_id"]}


def test_messy_rows(spark):
    got = packing.pack(documents(spark, MESSY)).collect()
    check(got, packing.CAPACITY)
    assert sum(r["length"] for r in got) == sum(map(len, ids_of([t for _, t in MESSY], 0)))
    assert sum(r["piece"] == 0 for r in got) == len(MESSY)
    assert packing.pack(documents(spark, [])).count() == 0
