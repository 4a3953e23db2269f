"""A causal self-attention language model over subword ids, trained in numpy.

Bigram counts of the whole training corpus give each id a distribution of its own over
the next id. Attention over a window of ids corrects it: the next id's class is drawn
from a softmax over classes whose logits are the bigram's log shares plus what a causal
self-attention layer makes of the window; inside its class the id keeps its bigram
share. Windows overlap by half and each id is scored once, in the window where it has
the most to look back on.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stage import shared_folder, stage
from .subwords import encoder, tokenizer_path
from .text import lower_ascii, per_process, text_batches, words

WINDOW, STRIDE = 32, 16
WIDTH, CLASSES = 16, 64
#: Ids with an embedding of their own; the others have their class's.
EMBEDDED = 2048
#: Bigrams with a place in every task, the most frequent ones; the others are looked up by a join.
BIGRAMS = 1_000_000
#: Ids that the class clustering and the dense bigram table work on.
DENSE = 1024
#: Training documents and steps that the attention layer starts with, before it goes over all
#: training documents in so many rounds.
SAMPLE_DOCS, STEPS, BATCH, ROUNDS = 1500, 600, 256, 4
#: Windows that are scored at once, to fit a CPU's cache.
PART = 256
DISCOUNT = 0.75
#: Words with a counter of their own in every task (numbered by 16 bits); the others are counted by a shuffle.
FREQUENT_WORDS = 1 << 16
END = "\0end"


# ---- the model ------------------------------------------------------------------


@dataclass
class Counts:
    """Bigram model of ids by rank (0: most frequent). ``prev`` * ranks + ``next`` are sorted keys."""

    rank: np.ndarray  # id -> rank
    single: np.ndarray  # probability of each rank by itself
    context: np.ndarray  # how often each rank has a successor
    keys: np.ndarray
    counts: np.ndarray
    back: np.ndarray | None = None  # back-off mass of each rank, where ``keys`` are not all bigrams

    def backoff(self) -> np.ndarray:
        if self.back is not None:
            return self.back
        n = len(self.single)
        kept = np.bincount(self.keys // n, np.maximum(self.counts - DISCOUNT, 0), n)
        return 1 - kept / np.maximum(self.context, 1)

    def share(self, keys: np.ndarray, backoff: np.ndarray) -> np.ndarray:
        """Probability of each (prev, next) key."""
        n = len(self.single)
        prev, nxt = np.divmod(keys, n)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        seen = np.where(self.keys[at] == keys, np.maximum(self.counts[at] - DISCOUNT, 0), 0) if len(self.keys) else 0
        return seen / np.maximum(self.context[prev], 1) + backoff[prev] * self.single[nxt]


def centres(top: np.ndarray, classes: int, seed: int = 5) -> np.ndarray:
    """Spherical k-means of the rows of ``top``."""
    rng = np.random.default_rng(seed)
    centre = top[rng.choice(len(top), min(classes, len(top)), replace=False)]
    for _ in range(12):
        of = (top @ centre.T).argmax(axis=1)
        for k in range(len(centre)):
            if (of == k).any():
                v = top[of == k].sum(axis=0)
                centre[k] = v / max(np.linalg.norm(v), 1e-9)
    return centre


def cluster(counts: Counts, classes: int, seed: int = 5) -> np.ndarray:
    """Class of each rank, from what stands beside it."""
    n = len(counts.single)
    m = min(DENSE, n)
    prev, nxt = np.divmod(counts.keys, n)
    root = np.sqrt(counts.counts).astype(np.float32)

    def neighbours(lo: int, hi: int) -> np.ndarray:
        out = np.zeros((hi - lo, 2 * m), np.float32)
        a = (nxt < m) & (prev >= lo) & (prev < hi)
        out[prev[a] - lo, nxt[a]] = root[a]
        b = (prev < m) & (nxt >= lo) & (nxt < hi)
        out[nxt[b] - lo, m + prev[b]] = root[b]
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        return out

    centre = centres(neighbours(0, m), classes, seed)
    # the others in parts, to bound memory
    return np.concatenate([(neighbours(lo, min(lo + 2048, n)) @ centre.T).argmax(axis=1) for lo in range(0, n, 2048)])


@dataclass
class Model:
    rank: np.ndarray
    n: int
    of_class: np.ndarray  # rank -> class
    log_class: np.ndarray  # (prev rank, class): log share
    dense: np.ndarray  # (prev, next) among the first ranks: log share inside the class
    counts: Counts
    back: np.ndarray
    row: np.ndarray  # rank -> row of the three tables; -1 (no text) has the last row
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray  # and a one, which adds up the weights
    decay: np.ndarray  # weight by place looked at and place of the one who looks
    out: np.ndarray

    def inside(self, prev: np.ndarray, nxt: np.ndarray) -> np.ndarray:
        """log of the next id's share inside its class after ``prev``."""
        m = len(self.dense)
        res = self.dense[np.minimum(prev, m - 1), np.minimum(nxt, m - 1)]
        rare = np.flatnonzero((prev >= m) | (nxt >= m))
        if len(rare):
            p, q = prev[rare], nxt[rare]
            res[rare] = np.log(self.counts.share(p * self.n + q, self.back)) - self.log_class[p, self.of_class[q]]
        return res

    def context(self, x: np.ndarray) -> np.ndarray:
        """Attention's correction of the class logits after each of the last STRIDE ids of
        windows ``x`` (rows of WINDOW ranks; -1 where the text has not begun)."""
        r = self.row[x]
        return self._attend(self.query[r[:, WINDOW - STRIDE :]], self.key[r], self.value[r])

    def _attend(self, q: np.ndarray, k: np.ndarray, v: np.ndarray) -> np.ndarray:
        # weights with the places looked at before those who look: BLAS is faster on these
        s = k @ q.transpose(0, 2, 1).copy()
        np.exp(s, out=s)
        s *= self.decay
        h = (s.transpose(0, 2, 1) @ v).reshape(-1, v.shape[2])
        return (h[:, :-1] / (h[:, -1:] + np.float32(1e-9))) @ self.out

    def log10(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each text; ``starts`` cut ``ids``, which end with an end id
        each. Before a text stands its end id, as the beginning."""
        x = self.rank[ids]
        lengths = np.diff(starts)
        end = self.rank[ids[starts[1:] - 1]]
        # with the mark before it, a text's id k is predicted from positions up to k
        total = int(lengths.sum())
        doc = np.repeat(np.arange(len(lengths)), lengths)
        prev = np.empty(total, np.int64)
        prev[1:] = x[:-1]
        prev[starts[:-1]] = end
        # texts in blocks of STRIDE ids, with an empty block before each: a window is a block
        # to predict after and the block before it, so that neighbours share what they look at
        blocks = -(-lengths // STRIDE) + 1
        base = (np.cumsum(blocks) - blocks + 1) * STRIDE
        size = int(blocks.sum()) * STRIDE
        place = np.arange(total) + np.repeat(base - starts[:-1], lengths)
        looked, wanted = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        looked[place] = prev
        wanted[place] = self.of_class[x]
        logs = np.zeros(size, np.float32)
        ones = np.ones(self.out.shape[1], np.float32)
        for a in range(STRIDE, size, PART * STRIDE):
            b = min(a + PART * STRIDE, size)
            r = self.row.take(looked[a - STRIDE : b], mode="wrap")
            q = self.query.take(r[STRIDE:], axis=0).reshape(-1, STRIDE, self.query.shape[1])
            logits = self._attend(q, _pairs(self.key.take(r, axis=0)), _pairs(self.value.take(r, axis=0)))
            logits += self.log_class.take(looked[a:b], axis=0, mode="clip")
            logs[a:b] = logits[np.arange(b - a), wanted[a:b]]
            np.exp(logits, out=logits)
            logs[a:b] -= np.log(logits @ ones)
        return np.bincount(doc, logs[place] + self.inside(prev, x), len(lengths)) / np.log(10)


def _pairs(rows: np.ndarray) -> np.ndarray:
    """Each block of STRIDE rows with the one before it, without a copy."""
    step, width = rows.strides
    return np.lib.stride_tricks.as_strided(rows, (len(rows) // STRIDE - 1, 2 * STRIDE, rows.shape[1]), (STRIDE * step, step, width), writeable=False)


def _causal() -> np.ndarray:
    """(place looked at, place of the one who looks): 1 where it may."""
    return (np.arange(WINDOW)[:, None] <= np.arange(WINDOW - STRIDE, WINDOW)[None, :]).astype(np.float32)


def _distances() -> np.ndarray:
    return np.maximum(np.arange(WINDOW - STRIDE, WINDOW)[None, :] - np.arange(WINDOW)[:, None], 0)


@dataclass
class Tables:
    """What the model takes from all bigrams together; bounded by the vocabulary."""

    of_class: np.ndarray
    by_class: np.ndarray  # (prev rank, class): discounted counts
    first: Counts  # all bigrams among the first ranks


def tables(counts: Counts, classes: int) -> Tables:
    """From counts that hold all bigrams."""
    n = len(counts.single)
    of_class = cluster(counts, classes)
    prev, nxt = np.divmod(counts.keys, n)
    by_class = np.bincount(prev * classes + of_class[nxt], np.maximum(counts.counts - DISCOUNT, 0), n * classes)
    return Tables(of_class, by_class.reshape(n, classes), counts)


def fit(counts: Counts, sample: list[np.ndarray], classes: int = CLASSES, steps: int = STEPS, seed: int = 11, known: Tables | None = None, further: Callable[[Layer], object] | None = None) -> Model:
    """Train the attention layer on id sequences (each ends with the end id) by Adam, and
    then by ``further``. ``known`` has to be given if ``counts`` do not hold all bigrams."""
    n = len(counts.single)
    back = counts.backoff()
    known = known or tables(counts, classes)
    of_class = known.of_class
    rest = np.bincount(of_class, counts.single, classes)
    log_class = np.log(known.by_class / np.maximum(counts.context, 1)[:, None] + back[:, None] * rest + 1e-30).astype(np.float32)
    m = min(DENSE, n)
    pairs = (np.arange(m)[:, None] * n + np.arange(m)[None, :]).ravel()
    dense = np.log(known.first.share(pairs, back) + 1e-30).reshape(m, m) - log_class[:m][:, of_class[:m]]
    own = min(EMBEDDED, n)
    row = np.where(np.arange(n) < own, np.arange(n), own + of_class)
    rng = np.random.default_rng(seed)
    size = own + classes
    x = rng.normal(0, 0.3, (size, WIDTH)).astype(np.float32)
    wq, wk, wv = (rng.normal(0, 0.25, (WIDTH, WIDTH)).astype(np.float32) for _ in range(3))
    params = [x, wq, wk, wv, np.zeros((WIDTH, classes), np.float32), np.linspace(0, -1, WINDOW).astype(np.float32)]
    layer = Layer(row, of_class, log_class, params)
    windows, targets = windows_of([np.concatenate([[counts.rank[s[-1]]], counts.rank[s]]) for s in sample if len(s)])
    if len(windows):
        for step in range(1, steps + 1):
            pick = rng.integers(len(windows), size=BATCH)
            layer.step(windows[pick], targets[pick], 0.02 * (1 - 0.9 * step / steps))
    if further is not None:
        further(layer)
    x, wq, wk, wv, out, bias = layer.params
    x = np.concatenate([x, np.zeros((1, WIDTH), np.float32)])
    value = np.append(x @ wv, np.ones((len(x), 1), np.float32), axis=1)
    value[-1] = 0
    decay = np.exp(bias[_distances()]) * _causal()
    return Model(counts.rank, n, of_class, log_class, dense.astype(np.float32), counts, back, np.append(row, size), x @ wq / np.float32(WIDTH**0.5), x @ wk, value, decay, out.copy())


def _product(a: np.ndarray, b: np.ndarray, parts: int) -> np.ndarray:
    """``a``.T @ ``b`` of long and narrow tables, in so many parts: short ones are multiplied faster."""
    return (a.reshape(parts, -1, a.shape[1]).transpose(0, 2, 1) @ b.reshape(parts, -1, b.shape[1])).sum(axis=0)


def windows_of(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ranks (WINDOW looked at) and the STRIDE ranks to predict, of texts that
    begin with their end id; -1 where a text has not begun or is over."""
    windows = [np.zeros((0, WINDOW + 1), np.int32)]
    for s in streams:
        padded = np.concatenate([np.full(WINDOW - STRIDE, -1), s, np.full(-(len(s) - 1) % STRIDE, -1)]).astype(np.int32)
        windows.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW + 1)[::STRIDE])
    both = np.concatenate(windows)
    return both[:, :WINDOW], both[:, WINDOW - STRIDE + 1 :]


class Layer:
    """The attention layer in training, with Adam's moments."""

    def __init__(self, row: np.ndarray, of_class: np.ndarray, log_class: np.ndarray, params: list[np.ndarray]):
        self.row, self.of_class, self.log_class = row, of_class, log_class
        kind, self.cuts = np.result_type(*params), np.cumsum([0, *(p.size for p in params)])
        # parameters and both moments lie side by side, so that a step takes a few operations
        self.state = np.zeros((3, self.cuts[-1]), kind)
        self.params = [self.state[0, a:b].reshape(p.shape) for a, b, p in zip(self.cuts, self.cuts[1:], params)]
        for mine, p in zip(self.params, params):
            mine[...] = p
        self.steps = 0
        # position -1, where a text has not begun, has the row after the last: all zeros
        self.row_of = np.append(row, len(params[0])).astype(np.int16 if len(params[0]) < 1 << 15 else np.int64)
        self.padded = np.zeros((len(params[0]) + 1, params[0].shape[1]), kind)
        self.looked = np.ones((len(self.padded), 2 * self.padded.shape[1] + 1), kind)
        self.looked[-1] = 0

    def gradients(self, w: np.ndarray, t: np.ndarray) -> list[np.ndarray]:
        """Of the mean loss over the ids to predict."""
        x, wq, wk, wv, out, bias = self.params
        flat = np.empty_like(self.state[0])
        sums = [flat[a:b].reshape(p.shape) for a, b, p in zip(self.cuts, self.cuts[1:], self.params)]
        n, d, half, kind = len(w), len(wq), WINDOW - STRIDE, self.padded.dtype
        ok = (t >= 0) & (w[:, half:] >= 0)
        weight = (ok.astype(kind) / max(int(ok.sum()), 1)).ravel()
        distance, scale, both = _distances(), kind.type(d**-0.5), np.concatenate([wk, wv], axis=1)
        self.padded[:-1] = x
        # values have a column of ones, which adds up the weights; where no text is, all is zero
        self.looked[:, : 2 * d] = self.padded @ both
        r = self.row_of[w]
        e, kv = self.padded.take(r.ravel(), axis=0), self.looked.take(r, axis=0)
        asked = e.reshape(n, WINDOW, d)[:, half:].reshape(-1, d)
        q = (asked @ (wq * scale)).reshape(n, STRIDE, d)
        k, v = kv[:, :, :d], kv[:, :, d:]
        # weights with the places looked at before those who look: BLAS is faster on these
        s = k @ q.transpose(0, 2, 1).copy()
        s += bias[distance]
        np.clip(s, -30, 30, out=s)
        np.exp(s, out=s)
        s *= _causal()
        h = (s.transpose(0, 2, 1) @ v).reshape(-1, d + 1)
        total = h[:, d:] + kind.type(1e-9)
        h = h[:, :d] / total
        last, at = w[:, half:].ravel(), np.arange(n * STRIDE)  # of no text, -1: the first, without weight
        logits = h @ out
        logits += self.log_class.take(last, axis=0, mode="clip")
        with np.errstate(over="ignore"):
            p = np.exp(logits)
        z = p @ np.ones(p.shape[1], kind)
        if not (np.isfinite(z) & (z > 0)).all():
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            z = p @ np.ones(p.shape[1], kind)
        # the softmax is p / z; its divisor goes to the narrow sides of the products
        p[at, self.of_class[np.maximum(t, 0)].ravel()] -= z
        part = (weight / z)[:, None]
        sums[4][...] = _product(h * part, p, n)
        g = np.empty((n * STRIDE, d + 1), kind)
        np.multiply(p @ out.T, part / total, out=g[:, :d])
        np.negative(np.einsum("ij,ij->i", g[:, :d], h), out=g[:, d])
        g = g.reshape(n, STRIDE, d + 1)
        g_s = v @ g.transpose(0, 2, 1).copy()
        g_s *= s
        sums[5][...] = np.bincount(distance.ravel(), g_s.sum(axis=0).ravel(), WINDOW)
        g_q = (g_s.transpose(0, 2, 1) @ k).reshape(-1, d)
        g_q *= scale
        g_kv = np.empty((n, WINDOW, 2 * d), kind)
        np.matmul(g_s, q, out=g_kv[:, :, :d])
        np.matmul(s, g[:, :, :d], out=g_kv[:, :, d:])
        g_kv = g_kv.reshape(-1, 2 * d)
        g_e = g_kv @ both.T
        g_e.reshape(n, WINDOW, d)[:, half:] += (g_q @ wq.T).reshape(n, STRIDE, d)
        sums[1][...] = _product(asked, g_q, n)
        g_both = _product(e, g_kv, n)
        sums[2][...], sums[3][...] = g_both[:, :d], g_both[:, d:]
        order = np.argsort(r, axis=None, kind="stable")
        rows = r.ravel()[order]
        start = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        g_x = np.zeros_like(self.padded)
        g_x[rows[start]] = np.add.reduceat(g_e.take(order, axis=0), start, axis=0)
        sums[0][...] = g_x[:-1]
        return sums

    def step(self, w: np.ndarray, t: np.ndarray, rate: float) -> None:
        self.steps += 1
        p, a, b = self.state
        g = self.gradients(w, t)[0].base
        a *= 0.9
        a += 0.1 * g
        b *= 0.99
        b += 0.01 * (g * g)
        np.divide(b, 1 - 0.99**self.steps, out=g)
        np.sqrt(g, out=g)
        g += 1e-8
        np.divide(a, g, out=g)
        g *= rate / (1 - 0.9**self.steps)
        p -= g

    def flat(self) -> np.ndarray:
        """Parameters and moments in one."""
        return self.state.ravel().copy()

    def put(self, flat: np.ndarray) -> None:
        self.state[...] = flat.reshape(self.state.shape)


def learn(layer: Layer, documents: DataFrame, rank: np.ndarray, rounds: int = ROUNDS) -> int:
    """One pass over every window of ``documents`` (a, ids); how many there were.

    A round takes a share of the documents by hash. Its tasks start from one layer, step
    through all windows they have, and Spark averages what they end with by windows. The
    result depends a little on which task has which rows.
    """
    id_kind, slots, total = _id_kind(len(rank)), 16, 0

    def run(batches, rate: float) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        per_process("lm", "learn", lambda: True)  # the encoder's store goes
        task = TaskContext.get().partitionId()
        rng = np.random.default_rng(task)
        flat = layer.flat()
        mine = Layer(layer.row, layer.of_class, layer.log_class, [p.copy() for p in layer.params])
        mine.put(flat)
        mine.steps = max(layer.steps, 1)
        n, rest = 0, windows_of([])
        for batch in batches:
            texts = (np.frombuffer(x, id_kind) for x in batch.column(0).to_pylist())
            w, t = windows_of([rank[np.concatenate([x[-1:], x])] for x in texts])
            n += len(w)
            w, t = np.concatenate([rest[0], w]), np.concatenate([rest[1], t])
            mixed = rng.permutation(len(w))
            whole = len(w) // BATCH * BATCH
            for a in range(0, whole, BATCH):
                mine.step(w[mixed[a : a + BATCH]], t[mixed[a : a + BATCH]], rate)
            rest = w[mixed[whole:]], t[mixed[whole:]]
        if len(rest[0]):
            # a step as small as its windows are few
            mine.step(*rest, rate * len(rest[0]) / BATCH)
        if n:
            yield pa.record_batch([pa.array([task % slots]), pa.array([n]), pa.array([(mine.flat().astype(float) * n).tobytes()])], names=["slot", "n", "layer"])

    def add(batches) -> Iterator:
        import pyarrow as pa

        n, sums = 0, 0.0
        for batch in batches:
            for m, layer_ in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, sums = n + m, sums + np.frombuffer(layer_.as_py())
        if n:
            yield pa.record_batch([pa.array([n]), pa.array([sums.tobytes()])], names=["n", "layer"])

    for k in range(rounds):
        rate = 0.002 * (1 - 0.9 * k / rounds)
        part = documents.where(F.pmod(F.xxhash64("a"), F.lit(rounds)) == k).select("ids")
        ends = part.mapInArrow(lambda batches, rate=rate: run(batches, rate), "slot bigint, n bigint, layer binary")
        met = ends.repartition(slots, "slot").select("n", "layer").mapInArrow(add, "n bigint, layer binary").collect()
        n = sum(r["n"] for r in met)
        if n:
            layer.put(sum(np.frombuffer(r["layer"]) for r in met) / n)
            total += n
    return total


# ---- counting and scoring ----------------------------------------------------------

COUNTED = "kind int, a bigint, b bigint, n bigint, ids binary, hot binary, tail array<string>"
BIGRAM, FREQUENT, DOCUMENT, TAUGHT = range(4)


def _sample(docs: DataFrame, train: Column, size: int) -> list[str]:
    """Texts of about ``size`` training documents, twice as many at most, by hash of the id."""
    known = docs.where(train).where("text is not null")
    n = known.count()
    if not n:
        return []
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, size / n) * (1 << 30))
    return sorted(r[0] for r in known.where(drawn).select("text").limit(2 * size).collect())


def _frequent(texts: list[str]) -> list[str]:
    seen = Counter(chain.from_iterable(words(lower_ascii(t)) for t in texts))
    return [END, *sorted(sorted(seen, key=lambda w: (-seen[w], w))[: FREQUENT_WORDS - 1])]


def _id_kind(size: int):
    return np.uint16 if size <= 1 << 16 else np.uint32


class _Places:
    """Number among the frequent words, or -1, of each chunk an encoder has numbered."""

    def __init__(self, frequent: list[str]):
        self.number = {w: i for i, w in enumerate(frequent)}
        self.generation, self.of = -1, np.zeros(0, np.int32)

    def __call__(self, code, slots: np.ndarray) -> np.ndarray:
        if code.generation != self.generation:
            self.generation, self.of = code.generation, np.zeros(0, np.int32)
        new = code.names[len(self.of) :]
        if new:
            self.of = np.concatenate([self.of, np.fromiter(map(self.number.get, new, repeat(-1)), np.int32, len(new))])
        return self.of[slots]


def _count(docs: DataFrame, frequent: list[str], key: str, path: str, end_id: int) -> DataFrame:
    """One pass over all documents (doc_id, text, train, row_key), in rows of four kinds:
    BIGRAM and FREQUENT, what a task has counted in training documents (ids a, b; word number a);
    DOCUMENT, a document's ids, the numbers of its frequent words and all its other words;
    TAUGHT, the same of a training document."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        kinds = {"kind": pa.int32(), "a": pa.int64(), "b": pa.int64(), "n": pa.int64(), "ids": pa.binary(), "hot": pa.binary(), "tail": pa.list_(pa.string())}
        schema = pa.schema(list(kinds.items()))
        code = encoder(path)
        size = max(code.tokenizer.get_vocab_size(), end_id + 1)
        places = per_process("encoder", f"frequent:{key}", lambda: _Places(frequent))
        hot = np.zeros(len(frequent), np.int64)
        pairs, held = [], 0

        def rows_of(kind, m, **columns):
            columns["kind"] = np.broadcast_to(np.int32(kind), m) if np.isscalar(kind) else kind
            there = {c: x if isinstance(x, pa.Array) else pa.array(x, kinds[c], from_pandas=True) for c, x in columns.items()}
            return pa.record_batch([there[c] if c in there else pa.nulls(m, t) for c, t in kinds.items()], schema=schema)

        def merged():
            keys = np.concatenate([k for k, _ in pairs])
            unique, at = np.unique(keys, return_inverse=True)
            return unique, np.bincount(at, np.concatenate([n for _, n in pairs])).astype(np.int64)

        for batch in batches:
            texts, rows = batch.column("text").to_pylist(), batch.column("row_key").to_numpy()
            taught = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            # the tokenizer lower-cases by itself, so words in lower case have the ids of the text
            lists = [words(lower_ascii(t)) if t else [] for t in texts]
            ids, cut, slots = code.encode_chunks(lists)
            n, at = np.fromiter(map(len, lists), np.int64, len(lists)), places(code, slots)
            doc = np.repeat(np.arange(len(texts)), n)
            mine = at[taught[doc]]
            hot += np.bincount(mine[mine >= 0], minlength=len(hot))
            hot[0] += int(taught.sum())
            other = np.concatenate([[0], np.cumsum(at < 0)])
            flat = list(chain.from_iterable(lists))
            tail = pa.array([flat[i] for i in np.flatnonzero(at < 0).tolist()], pa.string())
            ids = np.insert(ids, cut[1:], end_id)
            cut = cut + np.arange(len(cut))
            hits = np.concatenate([[0], np.cumsum(at >= 0)])
            numbers, ends = at[at >= 0].astype(np.uint16), np.cumsum(n)
            slim = ids.astype(_id_kind(size))
            yield rows_of(
                np.where(taught, TAUGHT, DOCUMENT).astype(np.int32), len(rows), a=rows, b=batch.column("doc_id"), n=n,
                ids=[slim[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])],
                hot=[numbers[x:y].tobytes() for x, y in zip(hits[ends - n], hits[ends])],
                tail=pa.ListArray.from_arrays(pa.array(other[np.append(0, ends)], pa.int32()), tail),
            )
            prev = np.empty(len(ids), np.int64)
            prev[1:] = ids[:-1]
            prev[cut[:-1]] = end_id
            of = np.repeat(taught, np.diff(cut))
            pairs.append(np.unique((prev * size + ids)[of], return_counts=True))
            held += len(pairs[-1][0])
            if held > 1_000_000:
                pairs = [merged()]
                held = len(pairs[0][0])
                if held > 500_000:
                    yield rows_of(BIGRAM, held, a=pairs[0][0] // size, b=pairs[0][0] % size, n=pairs[0][1])
                    pairs, held = [], 0
        if pairs:
            k, m = merged()
            yield rows_of(BIGRAM, len(k), a=k // size, b=k % size, n=m)
        some = np.flatnonzero(hot)
        yield rows_of(FREQUENT, len(some), a=some, n=hot[some])

    return docs.select("doc_id", "text", "train", "row_key").mapInArrow(run, COUNTED)


def _stored(counted: DataFrame) -> DataFrame:
    """``counted``, written with each kind in files of its own."""
    spark = counted.sparkSession
    path, key = f"{shared_folder(spark)}/panelcast/lm-counts-{uuid.uuid4().hex}", "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, 8)  # a task has a writer for each kind, so that rows need no sorting
    try:
        counted.write.partitionBy("kind").parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(counted.schema).parquet(path)


def _bigram_model(counted: DataFrame, size: int, keep: int, classes: int) -> tuple[Counts, Tables | None, DataFrame | None]:
    """Counts of ids, of their ``keep`` most frequent bigrams and the back-off mass over all;
    and if there are more bigrams, what ``fit`` needs of all and the others (a, b, n)."""
    pairs = stage(counted.where(F.col("kind") == BIGRAM).groupBy("a", "b").agg(F.sum("n").alias("n")), "bigrams")
    by_next, by_prev, kinds = np.zeros(size), np.zeros(size), np.zeros(size)
    for col, into in (("b", by_next), ("a", by_prev)):
        t = pairs.groupBy(col).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toArrow()
        into[t.column(col).to_numpy()] = t.column("n").to_numpy()
    kinds[t.column("a").to_numpy()] = t.column("kinds").to_numpy()
    # a count below which no more than ``keep`` bigrams are left, from counts by size
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = sorted((tuple(r) for r in pairs.groupBy(level.alias("l")).count().collect()), reverse=True)
    total, least = 0, 1 << 30
    for lv, n in levels:
        if total + n > keep:
            break
        total, least = total + n, lv
    order = np.argsort(-by_next, kind="stable")
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    single = (by_next[order] + 0.1) / (by_next.sum() + 0.1 * size)
    context = by_prev[order]
    back = 1 - (context - DISCOUNT * kinds[order]) / np.maximum(context, 1)

    def counts_of(prev, nxt, n) -> Counts:
        keys = prev * size + nxt
        by_key = np.argsort(keys)
        return Counts(rank, single, context, keys[by_key], n[by_key].astype(float), back)

    kept = pairs.where(level >= least).toArrow()
    counts = counts_of(*(rank[kept.column(c).to_numpy()] for c in "ab"), kept.column("n").to_numpy())
    if total == sum(n for _, n in levels):
        return counts, None, None
    ranked = _ranked(pairs, rank)
    m = min(DENSE, size)
    among = ranked.where((F.col("prev") < m) & (F.col("next") < m)).toArrow()
    first = counts_of(*(among.column(c).to_numpy() for c in ("prev", "next", "n")))
    of_class = _classes(ranked, first, classes)
    return counts, Tables(of_class, _by_class(ranked, of_class, classes), first), pairs.where(level < least)


def _ranked(pairs: DataFrame, rank: np.ndarray) -> DataFrame:
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            columns = [rank[batch.column(0).to_numpy()], rank[batch.column(1).to_numpy()], batch.column(2)]
            yield pa.record_batch([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=["prev", "next", "n"])

    return pairs.select("a", "b", "n").mapInArrow(run, "prev bigint, next bigint, n bigint")


def _classes(ranked: DataFrame, first: Counts, classes: int) -> np.ndarray:
    """``cluster`` over bigrams in Spark: the first ranks give the centres, and every other
    rank comes to the one nearest to its at most 2 * DENSE neighbours among them."""
    n = len(first.single)
    m = min(DENSE, n)
    prev, nxt = np.divmod(first.keys, n)
    top = np.zeros((m, 2 * m), np.float32)
    top[prev, nxt] = np.sqrt(first.counts)
    top[nxt, m + prev] = np.sqrt(first.counts)
    top /= np.maximum(np.linalg.norm(top, axis=1, keepdims=True), 1e-9)
    centre = centres(top, classes)
    near = centre.T.copy()
    of_class = np.zeros(n, np.int64)
    of_class[:m] = (top @ near).argmax(axis=1)

    def run(batches) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rank, other, count = (batch.column(i).to_numpy() for i in range(3))
            order = np.argsort(rank, kind="stable")
            at, start = np.unique(rank[order], return_index=True)
            part = np.add.reduceat(near[other[order]] * np.sqrt(count[order])[:, None], start, axis=0) if len(at) else []
            for r, v in zip(at.tolist(), part):
                sums[r] = sums[r] + v if r in sums else v
        ranks = list(sums)
        yield pa.record_batch([pa.array(ranks, pa.int64()), pa.array([int(sums[r].argmax()) for r in ranks], pa.int64())], names=["rank", "class"])

    before = ranked.where((F.col("prev") >= m) & (F.col("next") < m)).select(F.col("prev").alias("rank"), F.col("next").alias("other"), "n")
    after = ranked.where((F.col("next") >= m) & (F.col("prev") < m)).select(F.col("next").alias("rank"), (F.col("prev") + m).alias("other"), "n")
    t = before.unionByName(after).repartition("rank").mapInArrow(run, "rank bigint, class bigint").toArrow()
    of_class[t.column("rank").to_numpy()] = t.column("class").to_numpy()
    return of_class


def _by_class(ranked: DataFrame, of_class: np.ndarray, classes: int) -> np.ndarray:
    """(prev rank, class of next): discounted counts, summed in tasks and then by Spark."""
    n = len(of_class)

    def run(batches) -> Iterator:
        import pyarrow as pa

        sums = np.zeros(n * classes)
        for batch in batches:
            prev, nxt, count = (batch.column(i).to_numpy() for i in range(3))
            np.add.at(sums, prev * classes + of_class[nxt], count - DISCOUNT)
        some = np.flatnonzero(sums)
        for a in range(0, len(some), 100_000):
            part = some[a : a + 100_000]
            yield pa.record_batch([pa.array(part), pa.array(sums[part])], names=["at", "c"])

    t = ranked.mapInArrow(run, "at bigint, c double").groupBy("at").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(n * classes)
    out[t.column("at").to_numpy()] = t.column("c").to_numpy()
    return out.reshape(n, classes)


def _rare_gains(documents: DataFrame, rare: DataFrame, counts: Counts) -> DataFrame:
    """row_key, gain: what each document's bigrams without a place in the tasks add to the
    natural log of back-off alone. A bigram that no training document has adds nothing."""
    size, rank, back = len(counts.single), counts.rank, counts.backoff()
    single, context, held = counts.single, counts.context, counts.keys
    id_kind, m = _id_kind(size), min(DENSE, size)

    def gains(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            prev, nxt = (rank[batch.column(i).to_numpy()] for i in range(2))
            alone = back[prev] * single[nxt]
            gain = np.log1p((batch.column(2).to_numpy() - DISCOUNT) / np.maximum(context[prev], 1) / alone)
            yield pa.record_batch([pa.array(prev * size + nxt), pa.array(gain)], names=["pair", "gain"])

    def wanted(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows, lists = batch.column(0).to_numpy(), [np.frombuffer(x, id_kind) for x in batch.column(1).to_pylist()]
            if not lists:
                continue
            cut = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            x = rank[np.concatenate(lists)]
            prev = np.empty(len(x), np.int64)
            prev[1:] = x[:-1]
            prev[cut[:-1]] = x[cut[1:] - 1]
            doc = np.repeat(np.arange(len(lists)), np.diff(cut))
            far = (prev >= m) | (x >= m)  # the dense table has the others
            pair, doc = (prev * size + x)[far], doc[far]
            if len(held):
                out = held[np.minimum(np.searchsorted(held, pair), len(held) - 1)] != pair
                pair, doc = pair[out], doc[out]
            order = np.lexsort((pair, doc))
            pair, doc = pair[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(doc) != 0)])) if len(pair) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(pair)))
            yield pa.record_batch([pa.array(rows[doc[new]]), pa.array(pair[new]), pa.array(times.astype(np.int64))], names=["row_key", "pair", "times"])

    known = rare.select("a", "b", "n").mapInArrow(gains, "pair bigint, gain double")
    asked = documents.select("a", "ids").mapInArrow(wanted, "row_key bigint, pair bigint, times bigint")
    return asked.join(known, "pair").select("row_key", (F.col("gain") * F.col("times")).alias("gain"))


def score(docs: DataFrame, train: Column, *, path: str | None = None, end_id: int | None = None, bigrams: int = BIGRAMS, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` says which rows may be learned from. ``base_score`` adds up log10 of
    (c + 1) / (N + V + 1) over the words and one end: c the word's count in the training
    rows, N their tokens, V their distinct tokens. ``score`` is the model's log10
    probability of the ids of the whole text and an end id. Null and empty texts are the
    end alone. Without a training row all counts are zero and the model is uniform over
    ids. Null ids and repeated rows stay; an empty table gives no rows.
    """
    from tokenizers import Tokenizer

    path = path or tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    size = tokenizer.get_vocab_size()
    end_id = size - 1 if end_id is None else end_id
    size = max(size, end_id + 1)
    text_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.coalesce(train, F.lit(False)).alias("train"))
    own = own.withColumn("row_key", F.xxhash64("doc_id", "text"))
    texts = _sample(own, F.col("train"), 2 * sample_docs)
    frequent = _frequent(texts)
    key = hashlib.sha256("\0".join(frequent).encode("utf-8", "surrogatepass")).hexdigest()
    counted = _stored(_count(own, frequent, key, path, end_id))

    code = encoder(path)
    ids, at = code.encode(texts[::2])
    sample = [np.append(ids[a:b].astype(np.int64), end_id) for a, b in zip(at, at[1:])]
    counts, known, rare = _bigram_model(counted, size, bigrams, CLASSES)
    taught = counted.where(F.col("kind") == TAUGHT).select("a", "ids")
    model = fit(counts, sample, CLASSES, known=known, further=lambda layer: learn(layer, taught, counts.rank))

    hot = np.zeros(len(frequent), np.int64)
    for r in counted.where(F.col("kind") == FREQUENT).groupBy("a").agg(F.sum("n").alias("n")).toLocalIterator():
        hot[r["a"]] = r["n"]
    kept = counted.where(F.col("kind").isin(DOCUMENT, TAUGHT)).select("a", "b", "n", "ids", "hot")
    # one shuffle by word counts the other words and hands the counts to their documents; words
    # come here for being rare in a sample, so none has many rows
    word = Window.partitionBy("word").orderBy(F.col("b").desc())
    tail = counted.where(F.col("kind").isin(DOCUMENT, TAUGHT)).select(
        F.explode("tail").alias("word"), F.col("a").alias("row_key"), (F.col("kind") == TAUGHT).cast("bigint").alias("b")
    ).select(
        "row_key", F.col("b").alias("taught"), F.sum("b").over(word.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("c"),
        F.row_number().over(word).alias("i"),
    )
    zero = F.lit(0).cast("bigint")
    met = tail.select(
        "row_key", "taught", (F.col("i") * F.col("taught") == 1).cast("bigint").alias("words"), F.log10(F.col("c") + 1).alias("logs"),
        (F.col("c") > 0).cast("bigint").alias("known"), zero.alias("copies"), F.lit(0.0).alias("gain"),
    )
    # the key of equal rows is one: their words come together and are shared out again
    nothing = [zero.alias("taught"), zero.alias("words"), F.lit(0.0).alias("logs"), zero.alias("known")]
    met = met.unionByName(kept.select(F.col("a").alias("row_key"), *nothing, F.lit(1).cast("bigint").alias("copies"), F.lit(0.0).alias("gain")))
    if rare is not None:
        met = met.unionByName(_rare_gains(kept, rare, counts).select("row_key", *nothing, zero.alias("copies"), "gain"))
    met = stage(met.groupBy("row_key").agg(*[F.sum(c).alias(c) for c in ("taught", "words", "logs", "known", "copies", "gain")]), "lm-words")
    tail_n, tail_v = met.agg(*[F.coalesce(F.sum(c), zero) for c in ("taught", "words")]).first()
    n, v = int(hot.sum()) + tail_n, int((hot > 0).sum()) + tail_v
    logs, model_key = np.log10(hot + 1.0), f"lm:{key}:{hashlib.sha256(model.out.tobytes() + model.counts.counts.tobytes()).hexdigest()}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm = per_process("lm", model_key, lambda: model)
        for batch in batches:
            numbers = [np.frombuffer(x, np.uint16) for x in batch["hot"]]
            own = np.concatenate(numbers) if numbers else np.zeros(0, np.uint16)
            doc = np.repeat(np.arange(len(batch)), [len(x) for x in numbers])
            hot_logs = np.bincount(doc, logs[own], len(batch)) + logs[0]
            hot_known = np.bincount(doc, hot[own] > 0, len(batch)).astype(np.int64) + int(hot[0] > 0)
            lists = [np.frombuffer(x, _id_kind(size)) for x in batch["ids"]]
            cut = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
            scores = lm.log10(np.concatenate(lists), cut) if lists else np.zeros(0)
            yield pd.DataFrame(
                {"doc_id": batch["b"].astype("Int64"), "row_key": batch["a"], "n_tokens": batch["n"] + 1, "hot_logs": hot_logs, "hot_known": hot_known, "score": scores}
            )

    scored = kept.mapInPandas(run, "doc_id bigint, row_key bigint, n_tokens bigint, hot_logs double, hot_known bigint, score double")
    out = scored.join(met.drop("taught", "words"), "row_key", "left")
    base = F.col("hot_logs") + F.col("logs") / F.col("copies") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1.0)))
    return out.select(
        "doc_id", "n_tokens", (F.col("hot_known") + F.col("known") / F.col("copies")).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.col("gain") / F.col("copies") / float(np.log(10))).alias("score"),
    )
