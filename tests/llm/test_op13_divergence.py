import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from llm_frames import LONG
from panelcast.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
FRAME = "doc_id bigint, text string, lang string, source string, n string, docs int, term string, total int, part int, value string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, s, "x", 1, "t", 2, 3, "v") for i, (t, g, s) in enumerate(rows)], FRAME)


def brute(rows, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = TERM.findall(lowered)
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang in {g for g, _ in groups}:
        own = sorted(s for g, s in groups if g == lang)
        kept = [t for t, n in docs[lang].items() if n >= 3]
        n = {s: {t: counts[lang, s][t] for t in kept} for s in own}
        whole = {t: sum(n[s][t] for s in own) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(n[s]) for s in own}, share(whole)
        far = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(sum(far(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(far(p[s][t], q[t]), t) for t in kept if n[s][t] > 0 and p[s][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(map(str, out))


def result(df):
    return sorted(str(tuple(r)) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_against_plain_counting(spark):
    rng = random.Random(2)
    words = [f"w{'abcdefgh'[i % 8]}{'xyzé日'[i % 5]}{'pqrst'[i // 40]}" for i in range(200)]
    rows = []
    for _ in range(260):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["hot"] * 6 + ["a", "b", None, "A", "é"])
        text = " ".join(rng.choice(words[: rng.choice([5, 50, 200])]).upper() if rng.random() < 0.1 else rng.choice(words) for _ in range(rng.randrange(0, 60)))
        rows.append((text, lang, source))
    rows += [(None, "en", "void"), ("", "fr", "void"), ("once only", "fr", "x"), (LONG, "en", "a"), ("a1b-c\x00d[e`f{g\x7fhİ\xa0k", "en", "b")] * 3
    rows += [("solo " * 5, "one", "s")] * 4
    for top in (3, 200):
        assert result(divergence.audit(frame(spark, rows).repartition(3), k=top)) == brute(rows, top)


def test_small_memory_gives_the_same(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(" ".join(f"t{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(6))}" for _ in range(40)), "en", f"s{chr(97 + rng.randrange(5))}") for _ in range(120)]
    want = brute(rows, 10)
    for name, value in (("HELD_TERMS", 20), ("HELD_PAIRS", 3), ("TERMS_AT_ONCE", 1), ("_CHUNK", 7)):
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(divergence.top_terms, "__defaults__", (10, 3, 2))
    assert result(divergence.audit(frame(spark, rows).repartition(4), k=10)) == want


def test_empty_table(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    assert result(divergence.audit(frame(spark, [(None, None, None), ("a", None, "x")]))) == ["('', '', 'pair', 'x', 0, 1)", "('', 'x', 'pair', '', 0, 1)"]


def test_skyband_keeps_what_fewer_than_k_dominate():
    rng = np.random.default_rng(1)
    for case in range(60):
        size, k = int(rng.integers(1, 120)), int(rng.integers(1, 6))
        n, total = rng.integers(1, 12, size), rng.integers(1, 30, size)
        over = (n[None] >= n[:, None]) & (total[None] <= total[:, None]) & (np.arange(size)[None] < np.arange(size)[:, None])
        cut = int(rng.integers(0, size))
        first, kept = divergence.skyband(n[:cut], total[:cut], k, at_once=7)
        rest, kept = divergence.skyband(n[cut:], total[cut:], k, kept, at_once=5)
        assert kept[2].sum() == first.sum() + rest.sum()
        assert (np.concatenate([first, rest]) == (over.sum(axis=1) < k)).all()


def test_the_skyband_is_what_is_ranked(spark):
    """Of 4,000 terms in one group, few are left to rank; the ranks are those of all."""
    rng = random.Random(3)
    rows = [("en", "s", f"w{i:05d}", rng.randrange(1, 40), 0) for i in range(4000)]
    rows = [(g, s, t, n, n + rng.randrange(0, 60)) for g, s, t, n, _ in rows]
    df = spark.createDataFrame(rows, "lang string, source string, term string, n bigint, total bigint").selectExpr("*", "n * 100 AS p", "total * 10 AS q", "4000 AS n_terms")
    want = sorted(((p - q) ** 2 // q * -1, t) for _, _, t, n, total in rows for p, q in [(n * 100, total * 10)] if p > q)[:20]
    got = [tuple(r) for r in divergence.top_terms(df, k=20, part_terms=500, merged=4).orderBy("rank").selectExpr("-value", "term").collect()]
    assert got == want
    band = divergence._retained(divergence._retained(df.where("p > q"), F.lit(8), 20), F.lit(2), 20).count()
    assert 20 <= band < 1000
