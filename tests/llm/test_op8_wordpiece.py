import random

from llm_frames import MESSY, documents
from panelcast.llm import wordpiece
from panelcast.llm.text import WORD, lower_ascii


def greedy(word, vocabulary):
    text, n, i = wordpiece.START + word, 0, 0
    while i < len(text):
        for j in range(len(text), i, -1):
            if text[i:j] in vocabulary:
                n, i = n + 1, j
                break
        else:
            n, i = n + len(text[i].encode()), i + 1
    return n


def test_automaton_counts_as_greedy_does():
    rng = random.Random(3)
    for _ in range(60):
        vocabulary = {wordpiece.START} | {"".join(rng.choice("abc▁") for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 25))}
        automaton = wordpiece.LongestMatch(vocabulary)
        for _ in range(80):
            word = "".join(rng.choice("abcdé") for _ in range(rng.randrange(0, 14)))
            assert automaton.count(word) == greedy(word, vocabulary), (vocabulary, word)


def test_whole_texts(spark):
    got = sorted((tuple(r) for r in wordpiece.token_counts(documents(spark, MESSY)).collect()), key=str)
    vocabulary = set(wordpiece.vocabulary(wordpiece.tokenizer_path("piece_bpe_32k.model")))
    longest = 64
    assert max(map(len, vocabulary)) < longest
    want = []
    for d, t in MESSY:
        ws = WORD.findall(lower_ascii(t or ""))
        want.append((d, len(ws), sum(greedy(w, vocabulary) if len(w) < 1000 else wordpiece.LongestMatch(vocabulary).count(w) for w in ws)))
    assert got == sorted(want, key=str)
    assert wordpiece.token_counts(documents(spark, [])).count() == 0
