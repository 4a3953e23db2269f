"""Small tables with everything that may go wrong in a row."""

CLASHING = "node string, key bigint, keys string, n int, row_key string, train string, at string, file string, word string, score string, piece string"
FILL = ("x", 1, "k", 2, "r", "t", "a", "f", "w", "s", "p")
LONG = "ä" * 30_000 + " " + "lorem ipsum dolor " * 4000


def documents(spark, rows):
    """(doc_id, text) rows with further columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, *FILL) for d, t in rows], f"doc_id bigint, text string, {CLASHING}")


MESSY = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (3, None), (4, ""), (5, " \t\n "), (None, "a row without an id"), (None, None), (6, LONG), (7, "one two"), (8, "ONE\ttwo"),
    (9, "a\x1cb c\xa0d <|endoftext|> İΣ it's 12 ½ é ́x ﬁ 日本語 🙂"),
]
