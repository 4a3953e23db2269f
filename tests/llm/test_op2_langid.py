import itertools

import numpy as np
import pytest

from llm_frames import FILL, MESSY, documents
from panelcast.llm import langid
from panelcast.llm.text import fold

SF = "/root/testdata/sf0.01"


def test_marginals_are_those_of_the_chain(monkeypatch):
    """Against the sum over all label sequences, with segments of two words."""
    monkeypatch.setattr(langid, "SEGMENT", 2)
    rng = np.random.default_rng(2)
    moves = rng.random((3, 3))
    moves /= moves.sum(axis=1, keepdims=True)
    counts = np.array([5, 0, 1, 4])
    emission = rng.normal(size=(10, 3))
    got = langid.marginals(emission, counts, moves)
    a = 0
    for n in counts:
        e = np.exp(emission[a : a + n])
        want = np.zeros((n, 3))
        for ys in itertools.product(range(3), repeat=int(n)):
            p = np.prod([e[t, y] for t, y in enumerate(ys)]) * np.prod([moves[x, y] for x, y in zip(ys, ys[1:])])
            for t, y in enumerate(ys):
                want[t, y] += p
        if n:
            assert got[a : a + n] == pytest.approx(want / want.sum(axis=1, keepdims=True))
        a += n


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.learn(docs.where(fold("doc_id", 5) != 0), 80)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs.where(fold("doc_id", 5) == 0).where("length(text) >= 40")
    got = langid.label(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98


def test_code_switching(spark, model):
    docs = {r["lang"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400").collect()}
    de, fr = " ".join(docs["de"].split()[:30]), " ".join(docs["fr"].split()[:30])
    (row,) = langid.label(documents(spark, [(1, f"{de} {fr}")]), model, spans=True).collect()
    spans = row["spans"]
    of = {k: s["lang"] for s in spans for k in range(s["first"], s["last"] + 1)}
    assert sum(of.get(k) == "de" for k in range(30)) >= 26 and sum(of.get(k) == "fr" for k in range(30, 60)) >= 26


def test_messy_rows(spark, model):
    got = langid.label(documents(spark, MESSY), model).collect()
    assert len(got) == len(MESSY)
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in (3, 4, 5):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    kept = langid.keep_known(documents(spark, MESSY + [(20, "1234 ... !!")]), model)
    assert {3, 4, 5, 20}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert len(kept.columns) == 2 + len(FILL)
    assert langid.label(documents(spark, []), model).count() == 0


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    (r,) = langid.label(documents(spark, [(1, "some text")]), langid.learn(empty)).collect()
    assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_mixed_text_is_kept(spark, model):
    """Many languages in like shares: each word is sure, none of them leads."""
    docs = {r["lang"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400").orderBy("doc_id").collect()}
    mixed = " ".join(" ".join(docs[lang].split()[:25]) for lang in sorted(docs)[:4])
    rows = documents(spark, [(1, mixed), (2, None), (3, "12 34"), (4, " ".join(docs["de"].split()[:25]))])
    (row,) = langid.label(rows.where("doc_id = 1"), model).collect()
    assert row["score"] < langid.LEAST_SCORE
    assert sorted(r["doc_id"] for r in langid.keep_known(rows, model).collect()) == [1, 4]
