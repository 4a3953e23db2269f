import numpy as np
import pytest

from llm_frames import MESSY, documents
from panelcast.llm import toxicity
from panelcast.llm.text import fold

SF = "/root/testdata/sf0.1"


def features(text):
    lexicon, machine = toxicity.Lexicon({"zork*": (1.0, toxicity.INSULT), "murde*": (1.0, toxicity.THREAT)}), toxicity.grammar()
    return dict(zip(toxicity.FEATURES, toxicity.clause_features(text, lexicon, machine)))


def test_grammar_tells_clauses_apart():
    plain, aimed = features("what an idiot this is."), features("you are an idiot.")
    denied, quoted = features("that man is not an idiot."), features("the paper said idiot again.")
    assert plain["insult"] and not plain["aimed"] and aimed["aimed"]
    assert denied["denied"] and not denied["insult"]
    assert quoted["quoted"] and not quoted["insult"]
    assert aimed["best_clause"] > plain["best_clause"] > denied["best_clause"]
    assert features("he said nothing. an idiot spoke.")["insult"]  # a report ends with its clause
    assert features("not one two three four idiot.")["insult"]  # a negation reaches only so far
    assert features("i will kill you.")["threat"]
    both = features("they said you are not an idiot.")
    assert both["denied"] and not both["insult"] and not both["quoted"]


def test_patterns_of_insults_and_threats():
    assert features("you are such an idiot.")["pinned"] and not features("you idiot.")["pinned"]
    assert not features("are you there, an idiot asked.")["pinned"]  # the linking verb comes after the target
    assert features("i am going to murder you.")["announced"] and not features("they murder people.")["announced"]
    said = features("she wrote that he is an idiot.")
    assert said["quoted"] and not said["pinned"]


def test_a_learned_threat_counts_as_a_threat(spark):
    plain = [f"we will kill and murder number {i}" for i in range(12)] + [f"you zorkish idiot number {i}" for i in range(12)]
    rows = [(i, t) for i, t in enumerate(plain)] + [(100 + i, f"a calm text with number {i}") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id bigint, toxic int")
    learned, weights, _ = toxicity.learn(documents(spark, rows), labels)
    assert learned["murder"][1] == toxicity.THREAT and learned["zorkish"][1] == toxicity.INSULT
    lexicon = toxicity.Lexicon(learned)
    assert lexicon["Murder!"][0] == toxicity.THREAT and lexicon["kill"][0] == toxicity.THREAT
    found = dict(zip(toxicity.FEATURES, toxicity.clause_features("i will murder them", lexicon, toxicity.grammar())))
    assert found["threat"] and found["announced"] and not found["insult"]
    assert len(weights) == len(toxicity.FEATURES)


def test_every_term_above_the_odds_is_learned(spark):
    word = lambda i: "q" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) + "zz"
    text = " ".join(word(i) for i in range(3000))
    rows = [(i, text) for i in range(6)] + [(100 + i, f"calm {i}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id bigint, toxic int")
    learned, _, _ = toxicity.learn(documents(spark, rows), labels)
    assert all(word(i) in learned for i in range(3000))


def test_composition_is_one_after_the_other():
    parts = toxicity.machines()
    start, arcs = toxicity.grammar()
    rng = np.random.default_rng(1)
    for _ in range(300):
        state, states = start, [p[0] for p in parts]
        for s in rng.integers(8, size=14).tolist():
            state, out, weight = arcs[state, s]
            total = 0.0
            for k, (_, a) in enumerate(parts):
                states[k], s, w = a[states[k], s]
                total += w
            assert (out, weight) == (s, pytest.approx(total))


def test_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(docs, labels.where(fold("doc_id", 5) != 0))
    held = labels.where(fold("doc_id", 5) == 0)
    got = toxicity.score(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").select("score", "toxic").collect()
    hits = [r["score"] >= 0.5 for r in got if r["toxic"] == 1]
    false = [r["score"] >= 0.5 for r in got if r["toxic"] == 0]
    assert np.mean(hits) > 0.8 and np.mean(false) < 0.01


def test_messy_rows_and_no_labels(spark):
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id bigint, toxic int")
    model = toxicity.learn(documents(spark, MESSY), labels)
    got = toxicity.score(documents(spark, MESSY + [(30, "you idiot, I will kill you!")]), model).collect()
    assert len(got) == len(MESSY) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert max(got, key=lambda r: r["score"])["doc_id"] == 30
    assert toxicity.score(documents(spark, []), model).count() == 0
