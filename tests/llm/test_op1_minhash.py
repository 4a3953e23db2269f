import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_frames import MESSY, documents
from panelcast.llm import minhash
from panelcast.llm.text import WORD, lower_ascii


def brute(rows):
    """doc_id -> (size, component) by all pairs."""
    sets = []
    for _, t in rows:
        w = WORD.findall(lower_ascii(t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return [(d, len(s), d if not s else least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=key)


def edited(rng, ws, n, vocabulary):
    ws = list(ws)
    for _ in range(n):
        ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
    return " ".join(ws)


def test_all_links_of_edited_families(spark):
    """Chains and stars of edits around the threshold, a line in many documents, copies."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(120)]
        now = base
        for k in range(14):
            rows.append((len(rows), edited(rng, now, k % 5, vocabulary)))
            if k % 4 == 3:
                now = rows[-1][1].split()
    line = "this same line stands in very many short documents of the table"
    rows += [(len(rows) + i, line + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 12)))) for i in range(80)]
    rows += [(len(rows) + i, rows[3][1]) for i in range(40)]
    got = minhash.near_duplicates(documents(spark, rows))
    assert result(got) == sorted(brute(rows), key=key)
    assert {(r["doc_id"], r["kept"]) for r in got.collect()} == {(d, d == c) for d, _, c in brute(rows)}


def test_messy_rows(spark):
    df = documents(spark, MESSY)
    assert result(minhash.near_duplicates(df)) == sorted(brute(MESSY), key=key)
    kept = minhash.drop_near_copies(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == [1, 3, 4, 5, 6, 7, 9]  # equal texts of 1, 2, 2 and of 7, 8 are one document each


def test_rows_are_dropped_not_ids(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(1, a), (2, a + " two words"), (2, b), (None, a), (None, c), (3, None), (3, ""), (3, c + " end"), (4, "few words"), (None, "few words")]
    odd = documents(spark, rows).withColumnsRenamed({"file": "_metadata", "node": "__gone", "word": "other 1.`x", "at": "row"})
    kept = minhash.drop_near_copies(odd.repartition(4))
    assert kept.columns == odd.columns
    want = [(1, a), (2, b), (3, ""), (3, c + " end"), (3, None), (4, "few words")]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_one_of_equal_rows_stays(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text)] * 3 + [(9, text + " x")] * 4
    assert [r["doc_id"] for r in minhash.drop_near_copies(documents(spark, rows)).collect()] == [9]
    assert minhash.drop_near_copies(documents(spark, [])).count() == 0


def test_empty_table(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    b = np.concatenate([a[:600], np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))])
    sig = minhash.signatures([a, b], 2048)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert np.mean(sig[0] == sig[1]) == pytest.approx(true, abs=0.04)


@pytest.mark.parametrize("kind", ["int", "string"])
def test_ids_of_other_types(spark, kind):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text), (2, text + " and more"), (3, "something else entirely in six words")]
    got = result(minhash.near_duplicates(documents(spark, rows).withColumn("doc_id", F.col("doc_id").cast(kind))))
    assert got == sorted(brute(rows), key=key)
