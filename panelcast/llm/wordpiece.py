"""Token counts by a linear longest-match automaton.

A trie of the vocabulary with failure links: when no piece goes on with the next
character, the link leads to the node of what is left once the longest pieces are cut
off, and a number kept with it says how many pieces those are. Each character is
passed once, and no piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .subwords import tokenizer_path
from .text import lower_ascii, per_process, text_batches, words

#: Marks the first piece of a word in the vocabulary.
START = "▁"
CACHE_WORDS = 400_000


class LongestMatch:
    """``count(word)``: how many pieces greedy longest match gives for START + word.
    A character that begins no piece counts as its UTF-8 bytes, as with byte fallback."""

    def __init__(self, vocabulary):
        self.go: list[dict[str, int]] = [{}]
        token, first = [False], [""]
        alphabet = {c for piece in vocabulary for c in piece}
        tokens = {p for p in vocabulary if p}
        for piece in tokens | alphabet:
            node = 0
            for c in piece:
                nxt = self.go[node].get(c)
                if nxt is None:
                    nxt = self.go[node][c] = len(self.go)
                    self.go.append({})
                    token.append(False)
                    first.append(first[node] or c)
                node = nxt
            token[node] = True
        n = len(self.go)
        self.fail, self.pops = [0] * n, [0] * n
        weight = [1] * n
        for c in alphabet - tokens:
            weight[self.go[0][c]] = len(c.encode())
        # Breadth first: the links of a node's prefix are known before its own.
        queue = deque((0, c, v) for c, v in self.go[0].items())
        while queue:
            parent, c, v = queue.popleft()
            queue.extend((v, d, w) for d, w in self.go[v].items())
            if token[v]:
                self.fail[v], self.pops[v] = 0, weight[v]
                continue
            # every single character is a token or stands for one, so the parent is not the root
            z, pops = self.fail[parent], self.pops[parent]
            while c not in self.go[z]:
                pops += self.pops[z]
                z = self.fail[z]
            self.fail[v], self.pops[v] = self.go[z][c], pops

    def count(self, word: str) -> int:
        go, fail, pops = self.go, self.fail, self.pops
        node, n = 0, 0
        for c in START + word:
            nxt = go[node].get(c)
            while nxt is None and node:
                n += pops[node]
                node = fail[node]
                nxt = go[node].get(c)
            if nxt is None:
                n += len(c.encode())
            else:
                node = nxt
        while node:
            n += pops[node]
            node = fail[node]
        return n


class _Counts(dict):
    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self[word] = self.automaton.count(word)
        return n


def vocabulary(path: str) -> list[str]:
    """The pieces of a public sentencepiece file, without control and byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text. Words are runs of anything but ASCII
    white space, A-Z lower-cased. Null and empty texts have no words and no tokens; null
    ids and repeated rows stay as they are."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = per_process("wordpiece", path, lambda: LongestMatch(vocabulary(path)))
        known = per_process("wordpiece", f"words:{path}", lambda: _Counts(automaton))
        for batch in batches:
            if len(known) > CACHE_WORDS:
                known.clear()
            lists = [words(lower_ascii(t)) if t else [] for t in batch["text"]]
            n_words = np.fromiter(map(len, lists), np.int64, len(lists))
            counts = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.int64, int(n_words.sum()))
            sums = np.concatenate([[0], np.cumsum(counts)])
            ends = np.cumsum(n_words)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_words": n_words, "n_tokens": sums[ends] - sums[ends - n_words]})

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(run, "doc_id bigint, n_words bigint, n_tokens bigint")
