"""Small tables with the odd cases that every operator has to bear."""

from __future__ import annotations

import random

WORDS = "time year people way day man thing woman life child world school state family group".split()

ODD_TEXTS = [
    None,
    "",
    " \n\t",
    "...!!!",
    "one",
    "one two three",
    "same words here again and again",
    "same words here again and again",
    "x" * 30_000,
    "word " * 5_000,
    "<|endoftext|> inside\x00 and \x1c odd é 日本 ß",
]


def prose(seed: int, n: int = 80) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "s", "ly", str(draw.randint(0, 99))]) for _ in range(n))


def document_rows() -> list[tuple]:
    """``doc_id, text, lang, source, n_chars`` and columns whose names clash with results."""
    rows = [(i, text, "en", "odd", 0, -1, "x") for i, text in enumerate(ODD_TEXTS)]
    rows += [(100 + i, prose(i), None if i % 7 == 0 else "en", "s", 0, -1, "x") for i in range(20)]
    # A repeated row, an id with two texts, rows without an id.
    rows += [(100, prose(0), "en", "s", 0, -1, "x"), (101, prose(50), "en", "s", 0, -1, "x")]
    rows += [(None, prose(60), "en", "s", 0, -1, "x"), (None, None, None, None, None, None, None)]
    return rows


#: ``n_words``, ``node`` and others also name columns of results.
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, node string"


def documents(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(document_rows() if rows is None else rows, DOCUMENTS)


def labels(spark, rows: list[tuple] | None = None):
    given = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(100, 120)] + [(None, 1, 0), (100, None, None), (7, 0, 1)]
    return spark.createDataFrame(given if rows is None else rows, "doc_id long, quality int, toxic int")
