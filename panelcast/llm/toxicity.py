"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon turns words into symbols: insults, threats, targets, negations, verbs of saying,
intentions ("going to"), linking verbs ("are"), other. Five small transducers read a
clause's symbols from left to right, rewrite them and add weights; they are composed once
into one machine. The insult transducer marks an insult that a linking verb pins on a
target, the threat transducer a violent word that an intention announces; then come
negation, reported speech and address. A clause matches if it holds an insult or a
threat; what it is worth depends on its marks. Words, the class of each (insult or
threat), and the weights of the marks are learned from labelled documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import stage
from .text import per_process, text_batches, words

#: Labelled documents read for learning, at most so many of each label (by hash of the id).
SAMPLE_PER_LABEL = 2500
#: Learned lexicon: words and word beginnings, each in so many toxic documents of the sample.
LEAST_DOCS = 5
#: Least log odds of a learned term; 3 is twenty to one.
LEAST_ODDS = 3.0
PREFIXES = (4, 5, 6)
CACHE_WORDS = 300_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, INTENT, COPULA = range(8)
#: Seed words in four languages.
SEEDS = {
    INSULT: "idiot moron stupid pathetic worthless scum trash loser imbecile dummkopf trottel abschaum connard crétin abruti imbécil estúpido basura",
    THREAT: "kill hurt destroy burn töten umbringen verprügeln tuer frapper détruire matar golpear destruir",
    TARGET: "you your he she they him her them du dich dein ihr sie er tu toi vous il elle ils tú usted ustedes él ella ellos",
    NEGATION: "not never no isn't aren't don't nicht kein keine nie niemals ne pas jamais non nunca jamás",
    INTENT: "will shall gonna going gotta must werde wirst wird werden will vais va allons vont voy vas van vamos",
    COPULA: "is are am was were being ist sind bist seid war est êtes suis sont es eres soy son está estás",
    REPORT: "said says wrote claimed called quoted sagte sagt schrieb nannte behauptete dit disait écrit prétend dijo dice escribió llamó",
}
_CLAUSE = re.compile(r"[.!?;:\n]+")
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")

# ---- transducers -----------------------------------------------------------
# A transducer is (start, {(state, symbol): (state, symbol, weight)}), with an arc for every
# symbol that may come. Insults and threats are rewritten by adding marks:
DENIED, QUOTED, AIMED, MARKED = 10, 20, 40, 80
BASE = (INSULT, THREAT)
SYMBOLS = range(8)


def _insult(reach: int = 4):
    """An insult within ``reach`` symbols after a target and its linking verb is pinned on it.
    States: 0; 1 to reach, a target that many symbols ago; beyond, a linking verb after it."""
    arcs = {}
    for state in range(2 * reach + 1):
        after = state > reach
        aged = 0 if state in (0, reach, 2 * reach) else state + 1
        for s in SYMBOLS:
            if s == TARGET:
                arcs[state, s] = (state if after else 1, s, 0.0)
            elif s == COPULA and state and not after:
                arcs[state, s] = (reach + 1, s, 0.0)
            elif s == INSULT and after:
                arcs[state, s] = (aged, s + MARKED, 0.5)
            else:
                arcs[state, s] = (aged, s, 0.0)
    return 0, arcs


def _threat(symbols, reach: int = 4):
    """A threat within ``reach`` symbols after a word of intention is announced."""
    arcs = {}
    for left, s in product(range(reach + 1), symbols):
        if s == INTENT:
            arcs[left, s] = (reach, s, 0.0)
        elif s == THREAT and left:
            arcs[left, s] = (left - 1, s + MARKED, 0.5)
        else:
            arcs[left, s] = (max(left - 1, 0), s, 0.0)
    return 0, arcs


def _negation(symbols, reach: int = 3):
    """What stands within ``reach`` symbols after a negation is denied."""
    arcs = {}
    for left, s in product(range(reach + 1), symbols):
        if s == NEGATION:
            arcs[left, s] = (reach, s, 0.0)
        elif s % 10 in BASE and left:
            arcs[left, s] = (left - 1, s + DENIED, -0.5)
        else:
            arcs[left, s] = (max(left - 1, 0), s, 0.0)
    return 0, arcs


def _reported(symbols):
    """What follows a verb of saying, up to the clause's end, is reported."""
    arcs = {}
    for state, s in product((0, 1), symbols):
        if s == REPORT:
            arcs[state, s] = (1, s, 0.0)
        elif state and s % 10 in BASE:
            arcs[state, s] = (1, s + QUOTED, -0.5)
        else:
            arcs[state, s] = (state, s, 0.0)
    return 0, arcs


def _aimed(symbols, reach: int = 6):
    """An insult or threat within ``reach`` symbols after a target is aimed at it."""
    arcs = {}
    for left, s in product(range(reach + 1), symbols):
        if s == TARGET:
            arcs[left, s] = (reach, s, 0.0)
        elif left and s % 10 in BASE:
            arcs[left, s] = (left - 1, s + AIMED, 0.5)
        else:
            arcs[left, s] = (max(left - 1, 0), s, 0.0)
    return 0, arcs


def machines() -> list:
    """The five transducers in their order, each with arcs for what the ones before it write."""
    out, symbols = [_insult()], [*SYMBOLS, INSULT + MARKED]
    for make, mark, marked in ((_threat, MARKED, (THREAT,)), (_negation, DENIED, BASE), (_reported, QUOTED, BASE), (_aimed, AIMED, BASE)):
        out.append(make(symbols))
        symbols = symbols + [s + mark for s in symbols if s % 10 in marked]
    return out


def compose(first, second):
    """The transducer that feeds the first one's output to the second; reachable states only."""
    (s1, a1), (s2, a2) = first, second
    inputs = {s for _, s in a1}
    start, arcs, open_, seen = (s1, s2), {}, [(s1, s2)], {(s1, s2)}
    while open_:
        p, q = open_.pop()
        for s in inputs:
            n1, out, w1 = a1[p, s]
            n2, out2, w2 = a2[q, out]
            arcs[(p, q), s] = ((n1, n2), out2, w1 + w2)
            if (n1, n2) not in seen:
                seen.add((n1, n2))
                open_.append((n1, n2))
    return start, arcs


def grammar():
    return reduce(compose, machines())


#: Marks of clauses that are counted and weighed.
CLASSES = ("insult", "threat", "denied", "quoted", "aimed", "pinned", "announced")
FEATURES = (*CLASSES, "best_clause", "clauses")


def clause_classes(symbols: list[int], strengths: list[float], machine) -> tuple[np.ndarray, float]:
    """Sums of word strengths by mark, and the clause's own weight."""
    state, arcs = machine
    out, total = np.zeros(len(CLASSES)), 0.0
    for s, strength in zip(symbols, strengths):
        state, wrote, weight = arcs[state, s]
        if s in BASE:
            marks = (wrote - s) // 10
            if marks & 1:
                out[2] += strength
            elif marks & 2:
                out[3] += strength
            else:
                out[0 if s == INSULT else 1] += strength
                if marks & 4:
                    out[4] += strength
                if marks & 8:
                    out[5 if s == INSULT else 6] += strength
            total += strength * (1 + weight)
    return out, total


#: term -> (strength, symbol)
Learned = dict[str, tuple[float, int]]


class Lexicon(dict):
    """word -> (symbol, strength). Learned terms end with * if they are beginnings; the strongest
    term that fits a word gives its class. Seeds keep theirs."""

    def __init__(self, learned: Learned):
        self.learned = learned
        self.seeds = {w: (s, 1.0 if s in BASE else 0.0) for s, ws in SEEDS.items() for w in ws.split()}

    def __missing__(self, word: str):
        bare = _EDGES.sub("", word).lower()
        found = self.seeds.get(bare, (OTHER, 0.0))
        terms = [bare, *(f"{bare[:n]}*" for n in PREFIXES if len(bare) >= n)]
        strength, symbol = max((self.learned.get(t, (0.0, OTHER)) for t in terms))
        if strength and found[0] in (OTHER, *BASE):  # words of the grammar stay what they are
            found = (found[0] or symbol, max(strength, found[1]))
        self[word] = found
        return found


def clause_features(text: str | None, lexicon: Lexicon, machine) -> np.ndarray:
    """FEATURES of a whole text; zeros if no clause matches."""
    ws = words(text)
    out = np.zeros(len(FEATURES))
    if not any(lexicon[w][0] in BASE for w in ws):
        return out
    best, n = 0.0, 0
    for clause in _CLAUSE.split(text):
        found = [lexicon[w] for w in words(clause)]
        if not any(s in BASE for s, _ in found):
            continue
        classes, weight = clause_classes([s for s, _ in found], [v for _, v in found], machine)
        out[: len(CLASSES)] += classes
        best, n = max(best, weight), n + 1
    out[: len(CLASSES)] = np.log1p(out[: len(CLASSES)])
    out[-2:] = best, np.log1p(n)
    return out


# ---- learning ----------------------------------------------------------------


def _terms(text):
    """Distinct words of a text, and their beginnings marked with *."""
    ws = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)))
    starts = [F.transform(F.filter(ws, lambda w, n=n: F.length(w) >= n), lambda w, n=n: F.concat(F.substring(w, 1, n), F.lit("*"))) for n in PREFIXES]
    return F.array_distinct(F.concat(ws, *starts))


def _learn_lexicon(sample: DataFrame) -> Learned:
    """Terms of toxic documents with their strength and class: a threat if documents with a seed
    of threat have the term oftener, by their number, than documents with a seed of insult."""
    n = dict(tuple(r) for r in sample.groupBy("toxic").count().collect())
    if len(n) < 2:
        return {}
    seed = lambda symbol: F.arrays_overlap("terms", F.array(*[F.lit(w) for w in SEEDS[symbol].split()])).cast("int")
    told = sample.select("toxic", _terms(F.col("text")).alias("terms")).select("toxic", "terms", *[(F.col("toxic") * seed(s)).alias(f"with_{s}") for s in BASE])
    of = told.agg(*[F.coalesce(F.sum(f"with_{s}"), F.lit(0)) for s in BASE]).first()
    counts = told.select("toxic", *[f"with_{s}" for s in BASE], F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"), *[F.sum(f"with_{s}").alias(f"with_{s}") for s in BASE]
    )
    odds = F.log((F.col("bad") + 0.5) / (n[1] + 1.0)) - F.log((F.col("good") + 2.0) / (n[0] + 4.0))
    insult, threat = ((F.col(f"with_{s}") + 0.5) / (of[i] + 1.0) for i, s in enumerate(BASE))
    symbol = F.when((F.col(f"with_{THREAT}") > 0) & (threat > insult), THREAT).otherwise(INSULT)
    best = counts.where(F.col("bad") >= LEAST_DOCS).withColumns({"odds": odds, "symbol": symbol}).where(F.col("odds") >= LEAST_ODDS)
    # as many rows as the bounded sample has such terms
    return {r["term"]: (min(r["odds"] / 4.0, 2.0), r["symbol"]) for r in best.select("term", "odds", "symbol").collect()}


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Newton's method on weighted rows, with a ridge on the weights."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(a.shape[1]), np.diag([l2] * x.shape[1] + [1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


#: Used where no label of both kinds can be learned from.
PRIOR = (np.array([1.5, 2.0, 0.3, 0.3, 0.5, 0.5, 0.5, 0.5, 0.5]), -2.5)


def _features(docs: DataFrame, learned: Learned, key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = per_process("toxicity", key, lambda: Lexicon(learned))
        machine = per_process("toxicity", "grammar", grammar)
        for batch in batches:
            if len(lexicon) > CACHE_WORDS:
                lexicon.clear()
            yield pd.DataFrame({"toxic": batch["toxic"], "x": [clause_features(t, lexicon, machine).tolist() for t in batch["text"]]})

    return docs.select("toxic", "text").mapInPandas(run, "toxic int, x array<double>")


def _digest(learned: Learned) -> str:
    return hashlib.sha256(repr(sorted(learned.items())).encode()).hexdigest()


def learn(docs: DataFrame, labels: DataFrame, sample_per_label: int = SAMPLE_PER_LABEL) -> tuple[Learned, np.ndarray, float]:
    """Lexicon and weights from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic). Only
    a bounded sample of each label is read; its rows stand for all of their label."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    n = dict(tuple(r) for r in known.groupBy("toxic").count().collect())
    if len(n) < 2:
        return {}, *PRIOR
    parts = [known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_per_label) for label in (0, 1)]
    drawn = parts[0].union(parts[1])
    text_batches(docs.sparkSession)
    sample = stage(docs.select("doc_id", "text").where("text is not null").join(drawn, "doc_id").select("toxic", "text"), "toxic-sample")
    learned = _learn_lexicon(sample)
    rows = _features(sample, learned, _digest(learned)).collect()  # a few numbers for each row of the sample
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return learned, *PRIOR
    return learned, *fit_logistic(x, y, np.where(y == 1, n[1] / y.sum(), n[0] / (1 - y).sum()) * len(y) / (n[0] + n[1]))


def score(docs: DataFrame, model: tuple[Learned, np.ndarray, float]) -> DataFrame:
    """doc_id, score (0 to 1), and ``clauses``: how many clauses matched. Texts that are
    null, empty or without a match get the score of no match; whole texts count, however long.
    Null ids and repeated rows stay, equal texts have equal scores, and an empty table gives no
    rows. Columns other than doc_id and text are not read, so their names do not matter."""
    learned, weights, bias = model
    key = _digest(learned)
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = per_process("toxicity", key, lambda: Lexicon(learned))
        machine = per_process("toxicity", "grammar", grammar)
        for batch in batches:
            if len(lexicon) > CACHE_WORDS:
                lexicon.clear()
            x = np.array([clause_features(t, lexicon, machine) for t in batch["text"]]).reshape(len(batch), len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": p, "clauses": np.round(np.expm1(x[:, -1])).astype(np.int64)})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, "doc_id bigint, score double, clauses bigint")
