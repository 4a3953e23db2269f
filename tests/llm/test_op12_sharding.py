import hashlib
import random
import zlib
from collections import Counter, defaultdict

from llm_frames import LONG, MESSY, documents
from panelcast.llm import sharding
from pyspark.sql import functions as F


class Listed(sharding.Ends):
    """Ends in a list instead of a table."""

    def split(self, stretches):
        news = []
        for low, high, width in stretches:
            bins = defaultdict(list)
            for e in self.table:
                if low <= e <= high:
                    bins[(e - low) // width].append(e)
            news += [(min(b), max(b), len(b) > 2) for b in bins.values()]
        olds = [b for b in zip(self.first, self.last, self.open) if not any(low <= b[0] and b[1] <= high for low, high, _ in stretches)]
        rows = sorted(olds + news)
        self.first, self.last, self.open = ([r[i] for r in rows] for i in range(3))


def smallest(sizes, shards):
    """Smallest largest run, by trying every capacity that a run can have."""
    capacity = max(max(sizes), -(-sum(sizes) // shards))
    while True:
        runs, left = 1, capacity
        for s in sizes:
            if s > left:
                runs, left = runs + 1, capacity
            left -= s
        if runs <= shards:
            return capacity
        capacity += 1


def test_capacity_and_cuts():
    rng = random.Random(11)
    for case in range(300):
        sizes = [rng.choice([1, 2, 3, 50, rng.randrange(1, 30)]) for _ in range(rng.randrange(1, 60))]
        if case % 4 == 0:
            sizes[rng.randrange(len(sizes))] = sum(sizes) // 2 + 1
        shards, ends, total = rng.randrange(1, 9), [], 0
        for s in sizes:
            total += s
            ends.append(total)
        want = smallest(sizes, shards)
        capacity, cuts, passes = sharding.minimax_cuts(Listed(ends), total, shards, first_bins=rng.choice([1, 3, 50]), bins=rng.choice([2, 5]))
        assert capacity == want
        assert all(c in ends or c == 0 for c in cuts) and cuts == sorted(cuts) and len(cuts) == shards - 1
        runs = [b - a for a, b in zip([0, *cuts], [*cuts, total])]
        assert max(runs) == want and passes <= 12
        if len(set(sizes)) == 1 and len(sizes) % shards == 0:
            assert len(set(runs)) == 1


def check(rows, out, shards):
    got = [r.asDict() for r in out.collect()]
    size = lambda t: len((t or "").encode()) + 1
    key = lambda i, t: (str(i), size(t), zlib.crc32((t or "").encode()))
    assert Counter(key(i, t) for i, t in rows) == Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got)
    assert {(r["law"], r["grown_shard"]) for r in got} <= {("bytes", None)}
    slots, held, of = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
        of[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    assert all(len(s) == 1 for s in of.values())  # equal texts stay together
    groups = defaultdict(lambda: [None, 0])
    for i, t in rows:
        own = groups[t or ""]
        own[0] = i if own[0] is None else own[0] if i is None else min(i, own[0])
        own[1] += size(t)
    order = sorted(groups.items(), key=lambda g: (g[1][0] is None, g[1][0] or 0, hashlib.sha256(g[0].encode()).hexdigest()))
    sizes = [n for _, (_, n) in order]
    assert max(held.values()) == smallest(sizes, shards) if len(sizes) < 400 else True
    # shards are runs of the groups in their order
    place = {(r["size"], r["text_crc32"]): r["shard"] for r in got}
    shards_in_order = [place[size(t), zlib.crc32(t.encode())] for t, _ in order]
    assert shards_in_order == sorted(shards_in_order)
    return held


def test_messy_rows(spark):
    rows = MESSY + [(40 + i, "copy") for i in range(30)] + [(90, "copy")] * 5 + [(50 + i, f"text {i} " + "x" * i) for i in range(80)]
    for shards, bins in ((16, 256), (3, 2)):
        out = sharding.assign(documents(spark, rows).repartition(5), shards, first_bins=bins, bins=bins)
        check(rows, out, shards)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_near_equal_and_one_hot_text(spark):
    rows = [(i, "word " * (i * 7919 % 97)) for i in range(1000)]
    held = check(rows, sharding.assign(documents(spark, rows)), 16)
    rows = [(i, f"{i} " + "y" * (i * 31 % 60)) for i in range(600)] + [(10_000 + i, "hot") for i in range(400)]
    held = check(rows, sharding.assign(documents(spark, rows)), 16)
    rest = sorted(held.values())[:-1]
    assert len(held) == 16 and rest[-1] <= 1.3 * rest[0]


def test_the_layout_does_not_matter_and_repeats_take_many_slots(spark):
    rows = [(i % 300, f"t{i % 300 % 17}") for i in range(3000)] + [(7, "same")] * 9000 + [(5000, LONG)]
    docs = documents(spark, rows)
    a, b = (sharding.assign(d).select(F.sum(F.xxhash64("doc_id", "size", "shard", "slot").cast("decimal(38,0)")), F.count("*")).first() for d in (docs, docs.repartition(9, "n", F.rand(3))))
    assert tuple(a) == tuple(b)
    check(rows, sharding.assign(docs), 16)


def test_empty_table(spark):
    assert sharding.assign(documents(spark, [])).count() == 0
    assert [tuple(r) for r in sharding.assign(documents(spark, [(None, None)])).select("doc_id", "size", "slot").collect()] == [(None, 1, 0)]
