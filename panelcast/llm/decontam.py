"""Benchmark decontamination: a BM25 index of test items, asked by every passage.

Documents are cut into overlapping passages long enough to hold any item whole. Items
are scored by BM25, as a share of what an item scores against itself, and all items at
or above a threshold are retrieved. Most passages can't reach it: for each item the
commonest terms, worth less than half the threshold together, are set aside, and a
passage is dropped if no item's other terms in it, plus all of those, come up to the
threshold. The rest run block-max WAND. What is retrieved is then verified on the words:
shingles of the whole item, and words of its answer (its last sentence).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import stage
from .text import per_process, text_batches

K1, B = 1.2, 0.75
#: Share of an item's own score from which it is retrieved.
THRESHOLD = 0.5
#: Share of the item's shingles, and of its answer's words, that a leak must hold.
OVERLAP = 0.75
WIDTH = 5
#: Items are searched in blocks of about so much text; each block is one pass.
BLOCK_BYTES = 8 << 20
POSTINGS_A_BLOCK = 32
_SENTENCE = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+")
_WORD = re.compile(r"[^\W_]+")


def terms_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case: marks around a passage don't hide it."""
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Posting:
    items: list[int]
    impacts: list[float]
    most: float
    #: for each block of postings: last item, greatest impact
    last: list[int]
    block_most: list[float]


def _shingles(ws: list[str], width: int) -> set[tuple[str, ...]]:
    return {tuple(ws[i : i + width]) for i in range(max(len(ws) - width, 0) + 1)} if ws else set()


class ItemIndex:
    """Inverted index of one block of items. ``df`` and the averages are of all items."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_length: float, threshold: float, width: int = WIDTH):
        self.threshold = threshold
        self.ids, self.shingles, self.answers = [], [], []
        lists: dict[str, list[tuple[int, float]]] = {}
        # an item's postings set aside, and what they are worth together
        self.aside: list[float] = []
        essential: list[tuple[str, int, float]] = []
        self.longest = 1
        for item, text in items:
            ws = terms_of(text)
            if not ws:
                continue
            k = len(self.ids)
            self.ids.append(item)
            self.longest = max(self.longest, len(ws))
            self.shingles.append(_shingles(ws, width))
            self.answers.append(set(terms_of(_SENTENCE.split(text.strip())[-1])) or set(ws))
            own = {}
            for w, tf in Counter(ws).items():
                idf = math.log(1 + (n_items - df[w] + 0.5) / (df[w] + 0.5))
                own[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / mean_length))
            total = sum(own.values())
            aside = 0.0
            for w in sorted(own, key=lambda w: (-df[w], w)):
                impact = own[w] / total
                lists.setdefault(w, []).append((k, impact))
                if aside + impact < threshold / 2:
                    aside += impact
                else:
                    essential.append((w, k, impact))
            self.aside.append(aside)
        self.term = {w: t for t, w in enumerate(lists)}
        self.postings: list[Posting] = []
        for found in lists.values():
            ks, vs = [k for k, _ in found], [v for _, v in found]
            cut = range(0, len(ks), POSTINGS_A_BLOCK)
            self.postings.append(
                Posting(ks, vs, max(vs), [ks[min(a + POSTINGS_A_BLOCK, len(ks)) - 1] for a in cut], [max(vs[a : a + POSTINGS_A_BLOCK]) for a in cut])
            )
        # essential postings by term, as arrays
        essential.sort(key=lambda e: self.term[e[0]])
        terms = np.array([self.term[w] for w, _, _ in essential], np.int64)
        self.ess_start = np.searchsorted(terms, np.arange(len(self.term) + 1))
        self.ess_item = np.array([k for _, k, _ in essential], np.int64)
        self.ess_impact = np.array([v for _, _, v in essential], float)
        self.aside_sum = np.array(self.aside, float)

    def hopeful(self, window: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Of distinct (window, term) pairs, the windows in which some item can reach the threshold."""
        start, n = self.ess_start[term], self.ess_start[term + 1] - self.ess_start[term]
        at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pair = np.repeat(window, n) * len(self.ids) + self.ess_item[at]
        unique, inverse = np.unique(pair, return_inverse=True)
        score = np.bincount(inverse, self.ess_impact[at], len(unique)) + self.aside_sum[unique % max(len(self.ids), 1)]
        return np.unique(unique[score >= self.threshold - 1e-9] // max(len(self.ids), 1))

    def search(self, terms: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND: all (item, score) at or above the threshold for a set of terms."""
        need, end = self.threshold - 1e-9, len(self.ids)
        cursors = [[self.postings[t], 0] for t in terms]
        out = []
        at = lambda c: c[0].items[c[1]] if c[1] < len(c[0].items) else end
        while True:
            cursors = sorted((c for c in cursors if at(c) < end), key=at)
            bound, pivot = 0.0, None
            for i, c in enumerate(cursors):
                bound += c[0].most
                if bound >= need:
                    pivot = i
                    break
            if pivot is None:
                return out
            item = at(cursors[pivot])
            while pivot + 1 < len(cursors) and at(cursors[pivot + 1]) == item:
                pivot += 1
            # what the blocks that hold the pivot's item can give
            block_bound, next_end = 0.0, end
            for c in cursors[: pivot + 1]:
                k = c[1] // POSTINGS_A_BLOCK
                while k < len(c[0].last) and c[0].last[k] < item:
                    k += 1
                if k < len(c[0].last):
                    block_bound += c[0].block_most[k]
                    next_end = min(next_end, c[0].last[k])
            if block_bound < need:
                # no item up to the end of these blocks, or before the next list's, can do it
                target = next_end + 1
                if pivot + 1 < len(cursors):
                    target = min(target, at(cursors[pivot + 1]))
                target = max(target, item + 1)
                for c in cursors[: pivot + 1]:
                    self._skip(c, target)
            elif at(cursors[0]) == item:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    score += c[0].impacts[c[1]]
                    c[1] += 1
                if score >= need:
                    out.append((item, score))
            else:
                for c in cursors[:pivot]:
                    self._skip(c, item)

    @staticmethod
    def _skip(c: list, target: int) -> None:
        posting, k = c
        while k < len(posting.items) and posting.last[k // POSTINGS_A_BLOCK] < target:
            k = (k // POSTINGS_A_BLOCK + 1) * POSTINGS_A_BLOCK
        while k < len(posting.items) and posting.items[k] < target:
            k += 1
        c[1] = min(k, len(posting.items))

    def leaks(self, texts: list[str | None], overlap: float, width: int) -> list[list[tuple[int, float, float, float]]]:
        """For each text: verified (item, score, question overlap, answer overlap)."""
        stride = self.longest
        lists = [terms_of(t) for t in texts]
        # windows begin every ``stride`` words and are twice as long
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        n_windows = np.maximum(-(-counts // stride) - 1, 1)
        first = np.cumsum(n_windows) - n_windows
        get = self.term.get
        flat = np.fromiter((get(w, -1) for ws in lists for w in ws), np.int64, int(counts.sum()))
        doc = np.repeat(np.arange(len(lists)), counts)
        place = (np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)) // stride
        known = np.flatnonzero(flat >= 0)
        known = known[self.ess_start[flat[known] + 1] > self.ess_start[flat[known]]]
        term, d, k = flat[known], doc[known], place[known]
        n_terms = max(len(self.term), 1)
        pairs = []
        for shift in (0, 1):
            w = k - shift
            ok = (w >= 0) & (w < n_windows[d])
            pairs.append((first[d[ok]] + w[ok]) * n_terms + term[ok])
        pairs = np.unique(np.concatenate(pairs))
        found: list[dict[int, tuple[float, float, float]]] = [{} for _ in texts]
        for window in self.hopeful(pairs // n_terms, pairs % n_terms).tolist():
            d = int(np.searchsorted(first, window, "right")) - 1
            a = (window - int(first[d])) * stride
            ws = lists[d][a : a + 2 * stride]
            terms = sorted({t for w in ws if (t := get(w)) is not None})
            here = _shingles(ws, width)
            for item, score in self.search(terms):
                want = self.shingles[item]
                if len(want) == 1:
                    # items of at most one shingle: as a run of words
                    (run,) = want
                    question = float(any(tuple(ws[i : i + len(run)]) == run for i in range(len(ws) - len(run) + 1)))
                else:
                    question = len(want & here) / len(want)
                answer = len(self.answers[item].intersection(ws)) / len(self.answers[item])
                if question >= overlap and answer >= overlap:
                    found[d][item] = max(found[d].get(item, (0.0, 0.0, 0.0)), (score, question, answer))
        return [[(self.ids[i], *v) for i, v in f.items()] for f in found]


def item_blocks(items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> list[Finder]:
    """Searchers of the items, one for each block of about ``block_bytes`` of text; counts
    of terms are of all items. Items without words are left out."""
    text_batches(items.sparkSession)
    own = items.select(F.col("item_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(item_id=batch["item_id"].astype("Int64"), w=[terms_of(t) for t in batch["text"]])

    own = stage(own.mapInPandas(split, "item_id bigint, text string, w array<string>").where("size(w) > 0"), "items")
    size, n_items, mean = own.agg(F.sum(F.octet_length("text")), F.count("*"), F.avg(F.size("w"))).first()
    if not n_items:
        return []
    n_blocks = -(-size // block_bytes)
    blocked = own.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    term = blocked.select("block", F.explode(F.array_distinct("w")).alias("w"))
    df = term.groupBy("w").agg(F.count("*").alias("df"))
    out = []
    for block in range(n_blocks):
        # bounded by the block size: its items, and the counts of its terms
        part = [tuple(r) for r in blocked.where(F.col("block") == block).select("item_id", "text").collect()]
        if part:
            counts = dict(tuple(r) for r in term.where(F.col("block") == block).select("w").distinct().join(df, "w").collect())
            part.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            out.append(Finder(part, counts, n_items, mean, threshold, width))
    return out


@dataclass
class Finder:
    """One block of items; its index is built once in each executor's process."""

    items: list[tuple[int | None, str]]
    df: dict[str, int]
    n_items: int
    mean_length: float
    threshold: float
    width: int

    def __post_init__(self):
        told = repr((self.items, sorted(self.df.items()), self.n_items, self.mean_length, self.threshold, self.width))
        self.key = "items:" + hashlib.sha256(told.encode()).hexdigest()

    def __call__(self, texts: pd.Series, overlap: float) -> list[list[tuple[int, float, float, float]]]:
        index = per_process("items", self.key, lambda: ItemIndex(self.items, self.df, self.n_items, self.mean_length, self.threshold, self.width))
        return index.leaks(texts.tolist(), overlap, self.width)


def find_leaks(docs: DataFrame, items: DataFrame, *, overlap: float = OVERLAP, **options) -> DataFrame:
    """One row per document id and test item it holds: doc_id, item_id, score,
    question_overlap, answer_overlap (the best passage's).

    Items without words match nothing; repeated items are found as one; null ids of
    documents or items stay null. Null and empty texts hold nothing. Empty tables give
    no rows.
    """
    spark = docs.sparkSession
    text_batches(spark)
    kind = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"
    asked = docs.select(F.col("doc_id").cast("bigint"), "text")
    found = spark.createDataFrame([], kind)
    for finder in item_blocks(items, **options):

        def run(batches: Iterator[pd.DataFrame], finder=finder) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(d, *h) for d, hs in zip(batch["doc_id"], finder(batch["text"], overlap)) for h in hs]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        found = found.union(asked.mapInPandas(run, kind))
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*")


def drop_leaks(docs: DataFrame, items: DataFrame, *, overlap: float = OVERLAP, **options) -> DataFrame:
    """Documents that hold no test item, all columns; one pass a block, without a shuffle."""
    text_batches(docs.sparkSession)
    for finder in item_blocks(items, **options):
        docs = docs.where(_clean(finder, overlap)(F.col("text")))
    return docs


def _clean(finder: Finder, overlap: float):
    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([not hits for hits in finder(text, overlap)], dtype=bool)

    return clean
