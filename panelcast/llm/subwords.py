"""Fast encoding of whole texts with a public tokenizer.

A text's ids are the ids of its white-space separated chunks, one after another,
because the tokenizer drops white space before it splits. Chunks repeat, so each
process keeps the ids of the chunks it has seen (a bounded number of them) and
only new ones go through the library. When the store is full, chunks met again since
the last time stay and the others go. A word has the same ids whatever punctuation follows.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

from .text import per_process, words

CACHE_CHUNKS = 500_000
#: Letters of ASCII and Latin-1, then perhaps end punctuation: these chunks are split without the library's regular expressions.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")
#: Such letters, digits and ASCII signs, but no apostrophe (contractions) and no < (special tokens): the
#: library cuts these chunks into runs of letters, single digits and runs of signs.
_MIXED = re.compile("[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_RUNS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ÿ0-9]+")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The usual byte-to-letter map of byte-level BPE: printable bytes stand for
    themselves, the others for code points from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Slots(dict):
    """Numbers chunks as they are first asked for and lists the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.new.append(chunk)
        return n


class ChunkEncoder:
    """Ids of many texts as one flat array and offsets."""

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = False
        self.model = self.tokenizer.model
        self.cache_chunks = cache_chunks
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(128, 256)}
        self.plain = self._plain_is_exact()
        self._reset()

    def _reset(self) -> None:
        """Start a generation with the chunks that were met again in the last one."""
        old = getattr(self, "names", [])
        kept = np.flatnonzero(self.uses[: len(old)] > 1) if old else np.zeros(0, np.int64)
        if len(kept) > self.cache_chunks // 2:  # the most used half
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: self.cache_chunks // 2]])
        names = [old[i] for i in kept.tolist()]
        start, length = (self.start[kept], self.length[kept]) if old else (kept, kept)
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(start - (ends - length), length) + np.arange(total)] if total else np.zeros(0, np.uint32)
        self.slot = _Slots()
        self.slot.update(zip(names, range(len(names))))
        self.names, self.learned, self.used = names, len(names), total
        self.flat = np.resize(ids, max(1 << 16, 2 * total)).astype(np.uint32) if total else np.empty(1 << 16, np.uint32)
        size = max(1 << 14, 2 * len(names))
        self.start, self.length, self.uses = (np.zeros(size, np.int64) for _ in range(3))
        self.start[: len(names)], self.length[: len(names)] = ends - length, length
        self.generation = getattr(self, "generation", -1) + 1

    def _library(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]

    def _plain_is_exact(self) -> bool:
        """Whether this tokenizer lower-cases and splits as the short way below does."""
        probe = ["Hello", "ÄrGer.", "naïve,", "the!?", "Straße;", "xyzzyqwv...", "ÑANDÚ", "a"]
        mixed = ["to%%%", "und.34@Mail7.example.com", '"04dbEb91"', "555-7713", "(Élan_É)=`x`~{|}[\\]^", "+-*/#$&;:>?"]
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        try:
            return (
                all("<" in t for t in special)
                and all(self._split(_PLAIN.fullmatch(p)) == ids for p, ids in zip(probe, self._library(probe)))
                and all(self._runs(p, {}) == ids for p, ids in zip(mixed, self._library(mixed)))
            )
        except Exception:
            return False

    def _pieces(self, text: str) -> list[int]:
        return [t.id for t in self.model.tokenize(text)]

    def _word(self, word: str) -> list[int]:
        return self._pieces(word if word.isascii() else word.translate(self.letters))

    def _split(self, m: re.Match) -> list[int]:
        return self._word(m[1].lower()) + (self._pieces(m[2]) if m[2] else [])

    def _runs(self, chunk: str, known: dict[str, list[int]]) -> list[int]:
        out: list[int] = []
        for run in _RUNS.findall(chunk.lower()):
            if (ids := known.get(run)) is None:
                ids = known[run] = self._word(run)
            out += ids
        return out

    def _learn(self) -> None:
        """Ids of the chunks that got a slot since the last call."""
        new, known, hard = self.slot.new, {}, []
        lists: list[list[int]] = []
        slot, flat, start, length, learned = self.slot.get, self.flat, self.start, self.length, self.learned
        add, plain, tokenize, letters = lists.append, _PLAIN.fullmatch, self.model.tokenize, self.letters
        for chunk in new:
            if self.plain and (m := plain(chunk)):
                word, end = m.groups()
                word = word.lower()
                if (ids := known.get(word)) is None:
                    k = slot(word)  # the word may stand in the store without punctuation
                    if k is not None and k < learned:
                        ids = flat[start[k] : start[k] + length[k]].tolist()
                    else:
                        ids = [t.id for t in tokenize(word if word.isascii() else word.translate(letters))]
                    known[word] = ids
                if end:
                    if end not in known:
                        known[end] = self._pieces(end)
                    ids = ids + known[end]
                add(ids)
            elif self.plain and _MIXED.fullmatch(chunk):
                add(self._runs(chunk, known))
            else:
                hard.append(len(lists))
                add([])
        for i in range(0, len(hard), 1024):
            part = hard[i : i + 1024]
            for k, ids in zip(part, self._library([new[k] for k in part])):
                lists[k] = ids
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        total, n = int(lengths.sum()), self.learned
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        while n + len(new) > len(self.start):
            self.start, self.length, self.uses = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.start, self.length, self.uses))
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), np.uint32, total)
        self.length[n : n + len(new)] = lengths
        self.start[n : n + len(new)] = self.used + np.cumsum(lengths) - lengths
        self.used += total
        self.learned += len(new)
        self.names += new
        new.clear()

    def encode_chunks(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For lists of chunks: flat ids, where each list begins, and each chunk's number
        in ``names`` (numbers start anew with each ``generation``)."""
        if len(self.slot) > self.cache_chunks:
            self._reset()
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        slots = np.fromiter(map(self.slot.__getitem__, chain.from_iterable(lists)), np.int64, int(counts.sum()))
        if self.slot.new:
            self._learn()
        if len(slots):
            met = np.bincount(slots)
            self.uses[: len(met)] += met
        length = self.length[slots]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        # position of each id: its chunk's start plus its place in the chunk
        at = np.repeat(self.start[slots] - (ends - length), length) + np.arange(total)
        return self.flat[at], np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])], slots

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and for each text where it begins (one more entry than texts).
        Missing texts have no ids."""
        ids, at, _ = self.encode_chunks([words(t) for t in texts])
        return ids, at


def encoder(path: str) -> ChunkEncoder:
    return per_process("encoder", path, lambda: ChunkEncoder(path))
