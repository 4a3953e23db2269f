import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_frames import MESSY, documents
from panelcast.functions.stage import stage
from panelcast.llm import causal_lm
from panelcast.llm.text import WORD, fold, lower_ascii

SF = "/root/testdata/sf0.001"


def small_model(steps=30):
    rng = np.random.default_rng(0)
    size, end = 40, 39
    texts = [np.append(rng.integers(0, 20, rng.integers(1, 90)), end) for _ in range(60)]
    flows = [np.concatenate([[end], t]) for t in texts]
    keys, n = np.unique(np.concatenate([f[:-1] * size + f[1:] for f in flows]), return_counts=True)
    single = np.bincount(np.concatenate(texts), minlength=size) + 0.1
    counts = causal_lm.Counts(np.arange(size), single / single.sum(), np.bincount(keys // size, n, size), keys, n.astype(float))
    return causal_lm.fit(counts, texts, classes=6, steps=steps), size, end


def log10_of(model, *texts):
    ids = np.concatenate(texts)
    return model.log10(ids, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))


def test_a_distribution_after_every_context():
    """All continuations of a context add up to one: nothing of what follows leaks in."""
    model, size, end = small_model()
    for n in (0, 1, 7, 15, 16, 17, 40):
        head = np.arange(n) % 20
        one = log10_of(model, *[np.concatenate([head, [k, end]]) for k in range(size)])
        # P(head k end) = P(head) P(k | head) P(end | head k); the last factor from longer texts
        two = np.array([math.fsum(10 ** log10_of(model, *[np.concatenate([head, [k, m, end]]) for m in range(size)])) for k in range(4)])
        assert np.isfinite(one).all() and (two < 10 ** (one[:4] + 12)).all()
    contexts = np.tile(np.concatenate([[-1] * 10, np.arange(22)]), (1, 1))
    logits = model.context(contexts) + model.log_class[contexts[0, -causal_lm.STRIDE :]]
    share = np.exp(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
    for t in range(causal_lm.STRIDE):
        prev = np.full(size, contexts[0, causal_lm.WINDOW - causal_lm.STRIDE + t])
        nxt = np.arange(size)
        assert (share[t][model.of_class] * np.exp(model.inside(prev, nxt))).sum() == pytest.approx(1, abs=1e-4)


def test_texts_are_scored_apart_and_once():
    model, _, end = small_model()
    rng = np.random.default_rng(3)
    texts = [np.append(rng.integers(0, 20, n), end) for n in (0, 1, 15, 16, 17, 31, 32, 33, 200, 5)]
    together = log10_of(model, *texts)
    assert together == pytest.approx([log10_of(model, t)[0] for t in texts], rel=1e-5)
    # token by token with each window built by hand
    text = texts[8]
    before = np.concatenate([[end], text[:-1]])
    total = 0.0
    for t, nxt in enumerate(text):
        a = (t // causal_lm.STRIDE) * causal_lm.STRIDE
        window = np.full(causal_lm.WINDOW, -1)
        for k in range(causal_lm.WINDOW):
            at = a - (causal_lm.WINDOW - causal_lm.STRIDE) + k
            if 0 <= at <= t:  # later ids may not matter
                window[k] = before[at]
        row = (model.context(window[None]) + model.log_class[np.maximum(window[-causal_lm.STRIDE :], 0)])[t - a]
        total += row[model.of_class[nxt]] - np.log(np.exp(row).sum()) + model.inside(before[t : t + 1], np.array([nxt]))[0]
    assert together[8] == pytest.approx(total / math.log(10), rel=1e-4)


def base(rows, taught):
    lists = [[*WORD.findall(lower_ascii(t or "")), None] for _, t in rows]
    c = Counter(w for ws, ok in zip(lists, taught) if ok for w in ws)
    n, v = sum(c.values()), len(c)
    return [(d, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (d, _), ws in zip(rows, lists)]


def compare(got, want):
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=str)
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want, key=str)]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in sorted(want, key=str)], rel=1e-9)


def test_attention_is_better_than_bigrams_alone_on_held_out_documents(spark, monkeypatch):
    monkeypatch.setattr(causal_lm, "FREQUENT_WORDS", 200)  # most words take the shuffle
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", (fold("doc_id", 7) == 2).alias("h")).collect()}
    got = causal_lm.score(docs, fold("doc_id", 7) != 2).collect()
    compare(got, base(rows, [not held[d] for d, _ in rows]))
    assert all(r["score"] < 0 for r in got)
    fit = causal_lm.fit
    monkeypatch.setattr(causal_lm, "fit", lambda *a, **k: fit(*a, **{**k, "steps": 0, "further": None}))
    alone = causal_lm.score(docs, fold("doc_id", 7) != 2).collect()
    total = lambda rows: sum(r["score"] for r in rows if held[r["doc_id"]])
    # of a few hundred documents; whether the model also beats single words depends on the size
    assert total(got) > 0.985 * total(alone)


def test_messy_rows(spark):
    got = causal_lm.score(documents(spark, MESSY), F.col("doc_id") != 7).collect()
    compare(got, base(MESSY, [d is not None and d != 7 for d, _ in MESSY]))
    assert all(np.isfinite(r["score"]) for r in got)
    assert causal_lm.score(documents(spark, []), F.lit(True)).count() == 0
    nothing = causal_lm.score(documents(spark, MESSY[:3]), F.lit(False)).collect()
    compare(nothing, base(MESSY[:3], [False] * 3))


def test_no_bigram_is_left_out(spark):
    """Bigrams without a place in the tasks count as much as the others."""
    docs = stage(spark.read.parquet(f"{SF}/documents.parquet").limit(200), "docs")
    docs = docs.unionAll(docs.limit(3))  # equal rows share what is looked up
    train = fold("doc_id", 7) != 2
    want = sorted((r["doc_id"], r["score"]) for r in causal_lm.score(docs, train).collect())
    for few in (0, 300):
        got = sorted((r["doc_id"], r["score"]) for r in causal_lm.score(docs, train, bigrams=few).collect())
        assert [g[0] for g in got] == [w[0] for w in want]
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-4)


def test_all_training_documents_teach_the_layer(spark, monkeypatch):
    """Every window of every training document, and of no other, is stepped through."""
    docs = stage(spark.read.parquet(f"{SF}/documents.parquet").limit(120), "docs")
    train = fold("doc_id", 7) != 2
    seen, learn = [], causal_lm.learn

    def watched(layer, documents, rank):
        before = [p.copy() for p in layer.params]
        lengths = [len(r["ids"]) // np.dtype(causal_lm._id_kind(len(rank))).itemsize for r in documents.collect()]
        seen.append((learn(layer, documents, rank), sum(-(-n // causal_lm.STRIDE) for n in lengths), len(lengths)))
        assert all(np.isfinite(p).all() for p in layer.params) and any((a != b).any() for a, b in zip(before, layer.params))

    monkeypatch.setattr(causal_lm, "learn", watched)
    causal_lm.score(docs, train, sample_docs=5).count()
    assert len(seen) == 1 and seen[0][0] == seen[0][1] and seen[0][2] == docs.where(train).count()


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    n, classes = 12, 4
    log_class = np.log(rng.dirichlet(np.ones(classes), n))
    params = [rng.normal(0, 0.5, s) for s in ((n, causal_lm.WIDTH), *[(causal_lm.WIDTH,) * 2] * 3, (causal_lm.WIDTH, classes), (causal_lm.WINDOW,))]
    layer = causal_lm.Layer(np.arange(n), np.arange(n) % classes, log_class, params)
    w, t = causal_lm.windows_of([rng.integers(0, n, 41), rng.integers(0, n, 7)])

    def loss():
        x, wq, wk, wv, out, bias = layer.params
        total, count = 0.0, 0
        for a, b in zip(w, t):
            for i, nxt in enumerate(b):
                at = causal_lm.WINDOW - causal_lm.STRIDE + i
                if nxt < 0 or a[at] < 0:
                    continue
                js = [j for j in range(at + 1) if a[j] >= 0]
                z = np.array([x[a[at]] @ wq @ (x[a[j]] @ wk) / causal_lm.WIDTH**0.5 + bias[at - j] for j in js])
                z = np.exp(z) / np.exp(z).sum()
                row = sum(p * (x[a[j]] @ wv) for p, j in zip(z, js)) @ out + log_class[a[at]]
                total, count = total + np.log(np.exp(row).sum()) - row[nxt % classes], count + 1
        return total / count

    for p, g in zip(layer.params, layer.gradients(w, t)):
        for at in (0, p.size // 2, p.size - 1):
            kept = p.flat[at]
            p.flat[at] = kept + 1e-5
            up = loss()
            p.flat[at] = kept - 1e-5
            assert g.flat[at] == pytest.approx((up - loss()) / 2e-5, rel=1e-3, abs=1e-6)
            p.flat[at] = kept


def test_size_of_the_layer():
    assert (causal_lm.WIDTH, causal_lm.CLASSES) == (16, 64)


def test_training_rounds_read_training_documents_only(spark, monkeypatch):
    """The files that the rounds go over again hold no words, bigrams or held-out documents."""
    docs = stage(spark.read.parquet(f"{SF}/documents.parquet").limit(120), "docs")
    seen, learn = [], causal_lm.learn

    def watched(layer, documents, rank):
        files = [r[0] for r in documents.select(F.input_file_name()).distinct().collect()]
        seen.append((spark.read.parquet(*files).count(), documents.count()))
        return learn(layer, documents, rank)

    monkeypatch.setattr(causal_lm, "learn", watched)
    causal_lm.score(docs, fold("doc_id", 7) != 2, sample_docs=5).count()
    assert len(seen) == 1 and seen[0][0] == seen[0][1] > 0


def test_neighbouring_windows_share_what_they_look_at():
    rows = np.arange(4 * causal_lm.STRIDE * 3, dtype=np.float32).reshape(-1, 3)
    pairs = causal_lm._pairs(rows)
    assert np.shares_memory(pairs, rows)
    assert all((pairs[i] == rows[i * causal_lm.STRIDE : (i + 2) * causal_lm.STRIDE]).all() for i in range(3)) and len(pairs) == 3


def test_a_step_survives_logits_beyond_the_range_of_exp():
    rng = np.random.default_rng(2)
    n, classes, d = 9, 3, causal_lm.WIDTH
    params = [rng.normal(0, 1, s).astype(np.float32) for s in ((n, d), *[(d, d)] * 3, (d, classes), (causal_lm.WINDOW,))]
    params[4] *= 1000
    layer = causal_lm.Layer(np.arange(n), np.arange(n) % classes, np.log(rng.dirichlet(np.ones(classes), n)).astype(np.float32), params)
    layer.step(*causal_lm.windows_of([rng.integers(0, n, 50)]), 0.01)
    assert all(np.isfinite(p).all() for p in layer.params)
