import math
import random
from collections import Counter

from llm_frames import MESSY, documents
from panelcast.llm import decontam
from panelcast.llm.decontam import _SENTENCE, _shingles, terms_of


def brute(docs, items, threshold=decontam.THRESHOLD, overlap=decontam.OVERLAP, width=5):
    """Every window against every item, scored in full."""
    items = sorted({(i, t or "") for i, t in items if terms_of(t)}, key=str)
    lists = [terms_of(t) for _, t in items]
    df = Counter(w for ws in lists for w in set(ws))
    mean, stride = sum(map(len, lists)) / max(len(lists), 1), max(map(len, lists), default=1)
    out = {}
    for d, t in docs:
        ws = terms_of(t)
        for a in range(0, max(len(ws) - stride, 1), stride):
            window = ws[a : a + 2 * stride]
            for (i, text), own in zip(items, lists):
                impact = {}
                for w, tf in Counter(own).items():
                    idf = math.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5))
                    impact[w] = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))
                score = sum(v for w, v in impact.items() if w in window) / sum(impact.values())
                run = " " + " ".join(window) + " "
                g = _shingles(own, width)
                question = sum(f" {' '.join(s)} " in run for s in g) / len(g)
                answer = set(terms_of(_SENTENCE.split(text.strip())[-1])) or set(own)
                if score >= threshold - 1e-9 and question >= overlap and len(answer & set(window)) / len(answer) >= overlap:
                    out[d, i] = max(out.get((d, i), 0), round(score, 9))
    return out


def tables(seed=1):
    rng = random.Random(seed)
    common, rare = [f"c{k}" for k in range(15)], [f"r{k}" for k in range(400)]
    pick = lambda n: [rng.choice(common if rng.random() < 0.6 else rare) for _ in range(n)]
    items = [(k, " ".join(pick(rng.randrange(3, 30))).capitalize() + ". " + " ".join(pick(rng.randrange(1, 8))) + ".") for k in range(150)]
    docs = []
    for k in range(250):
        ws = pick(rng.randrange(0, 200))
        if k % 3 == 0:
            leak = rng.choice(items)[1].upper().split()
            for _ in range(k % 4):
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = ["**", *leak]
        docs.append((k, " ".join(ws)))
    return docs, items


def found(df):
    return {(r["doc_id"], r["item_id"]): round(r["score"], 9) for r in df.collect()}


def test_against_full_scores(spark):
    docs, items = tables()
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, w string")
    want = brute(docs, items)
    assert len(want) > 30
    df = documents(spark, docs)
    assert found(decontam.find_leaks(df, bench)) == want
    assert found(decontam.find_leaks(df, bench, block_bytes=4000)) == want  # several blocks of items
    kept = decontam.drop_leaks(df, bench)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want} and kept.columns == df.columns


def test_wand_returns_all_above_threshold():
    rng = random.Random(2)
    _, items = tables(3)
    lists = {i: terms_of(t) for i, t in items}
    df = Counter(w for ws in lists.values() for w in set(ws))
    for threshold in (0.1, 0.3, 0.5):
        index = decontam.ItemIndex(items, df, len(items), 20.0, threshold)
        for _ in range(60):
            terms = sorted(rng.sample(range(len(index.term)), rng.randrange(1, 60)))
            full = {}
            for t in terms:
                for k, v in zip(index.postings[t].items, index.postings[t].impacts):
                    full[k] = full.get(k, 0) + v
            assert dict(index.search(terms)).keys() == {k for k, v in full.items() if v >= threshold - 1e-9}


def test_messy_rows(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (4, "one two"), (None, "row without an id")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert found(decontam.find_leaks(documents(spark, MESSY), bench)).keys() == {(1, 1), (2, 1), (7, 4), (8, 4), (None, None)}
    empty = bench.limit(0)
    assert decontam.find_leaks(documents(spark, MESSY), empty).count() == 0
    assert decontam.drop_leaks(documents(spark, MESSY), empty).count() == len(MESSY)
    assert decontam.find_leaks(documents(spark, []), bench).count() == 0
