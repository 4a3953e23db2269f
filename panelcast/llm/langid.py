"""Language of every word by a linear-chain conditional random field, and of documents.

Features of a word are its identity (a learned lexicon), its first and last one to four
letters and its letter pairs and triples; transitions between the languages of
neighbouring words are learned with them. Training runs on spans of documents of
different languages strung together, so that the chain learns how rarely text switches.
Prediction is forward-backward over whole texts: documents are cut into segments whose
transfer matrices are multiplied up first, which gives the exact marginals of the whole
chain while all segments of a batch are worked on at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import per_process, text_batches, words

#: Labelled documents read for training: about so many of each language, by hash of the id.
SAMPLE_PER_LANG = 300
#: Training sequences and their length in words; spans of one language in them.
SEQUENCES, LENGTH, SPANS = 3000, 64, (8, 40)
BUCKETS = 1 << 15
SEGMENT = 64
CACHE_WORDS = 300_000
UNKNOWN = "und"
#: Documents on whose words the chain is less sure than this have no language of their own.
LEAST_SCORE = 0.4
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_LETTER = re.compile(r"[^\W\d_]")


def bare(word: str) -> str:
    """Lower case without marks at its ends; empty if it has no letter."""
    return _EDGES.sub("", word).lower() if _LETTER.search(word) else ""


# ---- features ----------------------------------------------------------------


def _hash(parts: list[np.ndarray], kind: int) -> np.ndarray:
    h = np.full(parts[0].shape, kind * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for p in parts:
        h = (h ^ p) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(3)) % np.uint32(BUCKETS)


def word_features(batch: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``batch``, feature numbers) for words of like length together;
    number BUCKETS means none. Every word must have a character."""
    lengths = np.fromiter(map(len, batch), np.int64, len(batch))
    levels = np.ceil(np.log2(np.maximum(lengths, 8))).astype(int)
    for level in np.unique(levels):
        at = np.flatnonzero(levels == level)
        width = int(lengths[at].max())
        for part in np.array_split(at, max(1, len(at) * width >> 20)):
            n = lengths[part]
            text = np.array([batch[i] for i in part], f"<U{width}").view(np.uint32).reshape(len(part), width)
            # start and end marks around the letters
            c = np.zeros((len(part), width + 2), np.uint32)
            c[:, 0], c[:, 1:-1] = 1, text
            c[np.arange(len(part)), n + 1] = 2
            inside = np.arange(width + 2)[None, :] <= (n + 1)[:, None]
            whole = np.zeros(len(part), np.uint32)
            for k in range(width):
                whole = np.where(k < n, (whole ^ text[:, k]) * np.uint32(0x01000193), whole)
            out = [_hash([whole], 1)[:, None]]
            rows = np.arange(len(part))
            for k in range(1, 5):
                ok = n >= k
                first = [c[:, 1 + j] for j in range(k)] if width >= k else [c[:, 1]]
                last = [c[rows, np.maximum(n - j, 0)] for j in range(k)]
                for kind, p in ((2, first), (3, last)):
                    out.append(np.where(ok, _hash(p, kind * 8 + k), BUCKETS)[:, None])
            for size in (2, 3):
                grams = _hash([c[:, j : c.shape[1] - size + 1 + j] for j in range(size)], 40 + size)
                out.append(np.where(inside[:, size - 1 :], grams, BUCKETS))
            yield part, np.hstack(out).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    #: feature weights, with a row of zeros at the end
    weights: np.ndarray
    #: transition probabilities, rows sum to one
    moves: np.ndarray

    def emissions(self, batch: list[str]) -> np.ndarray:
        out = np.zeros((len(batch), len(self.langs)))
        for at, features in word_features(batch):
            for part in np.array_split(np.arange(len(at)), max(1, features.size >> 21)):
                out[at[part]] = self.weights[features[part]].sum(axis=1)
        return out


# ---- forward-backward ----------------------------------------------------------


def marginals(emission: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Posterior of each label at each word; ``counts`` words for each document in turn."""
    total, n_labels = emission.shape
    if not total:
        return np.zeros((0, n_labels))
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    n_segments = -(-counts // SEGMENT)
    first = np.cumsum(n_segments) - n_segments
    n = int(n_segments.sum())
    doc = np.repeat(np.arange(len(counts)), n_segments)
    order = np.arange(n) - first[doc]
    begin = (np.cumsum(counts) - counts)[doc] + order * SEGMENT
    size = np.minimum(counts[doc] - order * SEGMENT, SEGMENT)
    steps = int(size.max())
    at = np.minimum(begin[:, None] + np.arange(steps)[None, :], total - 1)
    there = np.arange(steps)[None, :] < size[:, None]
    grid = np.where(there[:, :, None], e[at], 1.0)

    # each segment's product of emissions and moves
    product = np.broadcast_to(np.eye(n_labels), (n, n_labels, n_labels)).copy()
    many = n_segments[doc] > 1
    rows = np.flatnonzero(many)
    if len(rows):
        p = product[rows]
        for t in range(steps):
            q = ((p * grid[rows, t][:, None, :]).reshape(-1, n_labels) @ moves).reshape(p.shape)
            q /= q.max(axis=(1, 2), keepdims=True)
            p = np.where(there[rows, t][:, None, None], q, p)
        product[rows] = p
    enter = np.full((n, n_labels), 1.0 / n_labels)
    leave = np.ones((n, n_labels))
    longest = int(n_segments.max())
    for k in range(1, longest):
        s = first[n_segments > k] + k
        m = np.einsum("si,sij->sj", enter[s - 1], product[s - 1])
        enter[s] = m / m.sum(axis=1, keepdims=True)
    for k in range(longest - 1, 0, -1):
        s = first[n_segments > k] + k
        m = np.einsum("sij,sj->si", product[s], leave[s])
        leave[s - 1] = m / m.max(axis=1, keepdims=True)

    forward = np.empty((steps, n, n_labels))
    message = enter
    for t in range(steps):
        a = message * grid[:, t]
        a /= a.sum(axis=1, keepdims=True)
        forward[t] = a
        message = np.where(there[:, t][:, None], a @ moves, message)
    back = leave
    for t in range(steps - 1, -1, -1):
        # ``back`` is what comes after this word, as a message before its move
        b = back @ moves.T
        forward[t] *= b
        m = grid[:, t] * b
        back = np.where(there[:, t][:, None], m / m.max(axis=1, keepdims=True), back)
    out = forward.transpose(1, 0, 2)[there]
    return out / out.sum(axis=1, keepdims=True)


# ---- training --------------------------------------------------------------------


def _sequences(by_lang: list[list[list[str]]], rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Words and labels of SEQUENCES * LENGTH positions: spans of random documents."""
    out: list[str] = []
    labels = np.empty(SEQUENCES * LENGTH, np.int64)
    while len(out) < len(labels):
        lang = int(rng.integers(len(by_lang)))
        doc = by_lang[lang][int(rng.integers(len(by_lang[lang])))]
        n = int(rng.integers(*SPANS))
        a = int(rng.integers(max(len(doc) - n, 0) + 1))
        span = doc[a : a + n][: len(labels) - len(out)]
        labels[len(out) : len(out) + len(span)] = lang
        out += span
    return out, labels


def train(sample: list[tuple[str, str]], rounds: int = 60, rate: float = 0.25, l2: float = 1e-6) -> Model:
    """Maximum likelihood on (text, lang) rows, by Adam on the whole training set."""
    docs: dict[str, list[list[str]]] = {}
    for text, lang in sorted(sample):
        ws = [b for w in words(text) if (b := bare(w))]
        if ws:
            docs.setdefault(lang, []).append(ws)
    langs = sorted(docs)
    if len(langs) < 2:
        return Model(langs, np.zeros((BUCKETS + 1, len(langs))), np.ones((len(langs), len(langs))))
    tokens, gold = _sequences([docs[x] for x in langs], np.random.default_rng(7))
    distinct = sorted(set(tokens))
    number = {w: i for i, w in enumerate(distinct)}
    token = np.array([number[w] for w in tokens])
    parts = [(at, f) for at, f in word_features(distinct)]
    n = len(langs)
    one = np.eye(n)[gold].reshape(SEQUENCES, LENGTH, n)
    seen = np.einsum("sti,stj->ij", one[:, :-1], one[:, 1:])
    w, move = np.zeros((BUCKETS + 1, n)), np.zeros((n, n))
    state = [np.zeros_like(x) for x in (w, w, move, move)]
    for step in range(1, rounds + 1):
        a = np.exp(move - move.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        e = np.empty((len(distinct), n))
        for at, f in parts:
            e[at] = w[f].sum(axis=1)
        g = np.exp(e - e.max(axis=1, keepdims=True))[token].reshape(SEQUENCES, LENGTH, n)
        forward = np.empty_like(g)
        m = np.full((SEQUENCES, n), 1.0 / n)
        for t in range(LENGTH):
            f = m * g[:, t]
            forward[:, t] = f / f.sum(axis=1, keepdims=True)
            m = forward[:, t] @ a
        post = np.empty_like(g)
        pair = np.zeros((n, n))
        b = np.ones((SEQUENCES, n))
        for t in range(LENGTH - 1, -1, -1):
            p = forward[:, t] * b
            post[:, t] = p / p.sum(axis=1, keepdims=True)
            if t:
                q = g[:, t] * b
                joint = forward[:, t - 1][:, :, None] * a[None] * q[:, None, :]
                pair += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                b = q @ a.T
                b /= b.max(axis=1, keepdims=True)
        miss = (one - post).reshape(-1, n)
        by_word = np.stack([np.bincount(token, miss[:, k], len(distinct)) for k in range(n)], axis=1)
        gw = np.zeros_like(w)
        for at, f in parts:
            for k in range(n):
                gw[:, k] += np.bincount(f.ravel(), np.repeat(by_word[at, k], f.shape[1]), BUCKETS + 1)
        gw = gw / len(token) - l2 * w
        d = (seen - pair) / len(token)
        gm = d - a * d.sum(axis=1, keepdims=True)
        for x, grad, first, second in ((w, gw, state[0], state[1]), (move, gm, state[2], state[3])):
            first += 0.1 * (grad - first)
            second += 0.01 * (grad * grad - second)
            x += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        w[BUCKETS] = 0.0
    a = np.exp(move - move.max(axis=1, keepdims=True))
    return Model(langs, w.astype(np.float32), a / a.sum(axis=1, keepdims=True))


def learn(labelled: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """Model from rows (doc_id, text, lang) with text and lang, of a bounded sample: about
    ``sample_per_lang`` whole documents of each language, twice as many in all at most."""
    known = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = [tuple(r) for r in known.groupBy("lang").count().collect()]
    if not counts:
        return Model([], np.zeros((BUCKETS + 1, 0)), np.ones((0, 0)))
    # as a constant of the plan, one entry a language: no text is shuffled
    share = F.create_map(*[F.lit(v) for x, n in counts for v in (x, min(1.0, sample_per_lang / n))])
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)
    rows = known.where(drawn).select("text", "lang").limit(2 * sample_per_lang * len(counts)).collect()
    return train([tuple(r) for r in rows])


# ---- prediction --------------------------------------------------------------------


class _Words(dict):
    """word -> row of the emission table; row 0 is for words without a letter."""

    def __init__(self, model: Model):
        self.model, self.new, self.table = model, [], np.zeros((1 << 12, len(model.langs)), np.float32)
        self.n = 1

    def __missing__(self, word: str) -> int:
        b = bare(word)
        if not b:
            self[word] = 0
            return 0
        k = self[word] = self.n + len(self.new)
        self.new.append(b)
        return k

    def learn(self) -> None:
        end = self.n + len(self.new)
        while end > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[self.n : end] = self.model.emissions(self.new)
        self.n = end
        self.new.clear()


def _posteriors(texts, known: _Words) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Marginals of all words with a letter, how many each text has, and which words they are."""
    lists = [words(t) for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    slots = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.int64, int(counts.sum()))
    if known.new:
        known.learn()
    doc = np.repeat(np.arange(len(lists)), counts)
    lettered = np.flatnonzero(slots)
    per_doc = np.bincount(doc[lettered], minlength=len(lists))
    starts = np.cumsum(counts) - counts
    which = np.split(lettered - starts[doc[lettered]], np.cumsum(per_doc)[:-1]) if len(lists) else []
    return marginals(known.table[slots[lettered]], per_doc, known.model.moves), per_doc, which


class Predictor:
    """Predicts batches of texts in an executor's process; words it has met stay known."""

    def __init__(self, model: Model):
        self.model = model
        self.key = "langid:" + hashlib.sha256(model.weights.tobytes() + model.moves.tobytes() + repr(model.langs).encode()).hexdigest()

    def __call__(self, texts: pd.Series, spans: bool = False) -> pd.DataFrame:
        model = self.model
        if not model.langs:
            out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "sure": 0.0}, index=range(len(texts)))
            return out.assign(spans=[[] for _ in range(len(out))]) if spans else out
        known = per_process("langid", self.key, lambda: _Words(model))
        if len(known) > CACHE_WORDS:
            known.clear()
            known.n = 1
        post, n, which = _posteriors(texts, known)
        sums = np.concatenate([np.zeros((1, post.shape[1])), np.cumsum(post, axis=0)])
        ends = np.cumsum(n)
        mean = (sums[ends] - sums[ends - n]) / np.maximum(n, 1)[:, None]
        best = mean.argmax(axis=1)
        langs = np.array([*model.langs, UNKNOWN], object)
        score = np.where(n > 0, mean[np.arange(len(n)), best], 0.0).clip(0, 1)
        # how surely the words are labelled, in whatever languages
        tops = np.concatenate([[0.0], np.cumsum(post.max(axis=1))])
        sure = ((tops[ends] - tops[ends - n]) / np.maximum(n, 1)).clip(0, 1)
        out = pd.DataFrame({"lang_pred": langs[np.where(n > 0, best, -1)], "score": score, "sure": sure})
        if spans:
            tops = np.split(post.argmax(axis=1), ends[:-1]) if len(n) else []
            out["spans"] = [_runs(t, w, model.langs) for t, w in zip(tops, which)]
        return out


def label(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score (mean posterior of that language over the words), and with
    ``spans`` the runs of words in one language, as (first word, last word, lang).

    Null, empty and letterless texts are ``und`` with score 0 and no span, and so is
    everything if no language could be learned. Null ids and repeated rows stay.
    """
    text_batches(docs.sparkSession)
    predict = Predictor(model)
    kind = "doc_id bigint, lang_pred string, score double"
    if spans:
        kind += ", spans array<struct<first: bigint, last: bigint, lang: string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = predict(batch["text"], spans).drop(columns="sure")
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64"))
            yield out

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, kind)


def keep_known(docs: DataFrame, model: Model, least_score: float = LEAST_SCORE) -> DataFrame:
    """Rows whose language is known, all columns: not ``und``, and each word's likeliest
    language has on average a posterior of at least ``least_score``. One pass without a shuffle."""
    text_batches(docs.sparkSession)
    predict = Predictor(model)

    @F.pandas_udf("boolean")
    def known(text: pd.Series) -> pd.Series:
        out = predict(text)
        return (out["lang_pred"] != UNKNOWN) & (out["sure"] >= least_score)

    return docs.where(known(F.col("text")))


def _runs(top: np.ndarray, which: np.ndarray, langs: list[str]) -> list[tuple[int, int, str]]:
    if not len(top):
        return []
    cut = np.flatnonzero(np.diff(top)) + 1
    return [(int(which[a]), int(which[b - 1]), langs[top[a]]) for a, b in zip([0, *cut], [*cut, len(top)])]

