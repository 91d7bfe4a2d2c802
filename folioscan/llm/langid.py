"""Language identification in two steps: the family first, then the language.

A text is the bag of its byte trigrams, without case, digits and marks. Linear
support vector machines, one for each family against the rest, choose the family;
within it every two languages have a machine of their own, and the language with
most votes wins, the sum of its margins deciding ties. All machines are trained
on a bounded sample by stochastic subgradient descent.

A text that is null or has no letter is ``und`` with score 0. Without anything to
learn from every text is ``und``. Families of equal margin are told by the first of
them in alphabetical order. Repeated rows are predicted one by one; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import by_batch, filtered, remainder, rows_of, sample_ids, texts_of

FOLDS, HELD = 5, 0
#: Bound of the sample of each language, and of the languages: the most frequent are learned.
PER_LANGUAGE, LANGUAGES = 1200, 100
BUCKETS = 1 << 16
EPOCHS = 8
REGULAR = 1e-4
SEED = 11
UNKNOWN = "und"
#: Below this score the filter of a pipeline rejects a prediction.
LEAST_SCORE = 0.5

#: Families of languages by code; a language that is not listed is its own family.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "pl": "slavic", "cs": "slavic", "ru": "slavic", "uk": "slavic", "bg": "slavic", "sk": "slavic",
}

#: Letters of ASCII in lower case, other characters of ASCII as space.
LETTERS = bytes(b if b > 127 else b | 32 if chr(b).isalpha() else 32 for b in range(256))
SPACE = np.uint32(0x202020)


class Model(NamedTuple):
    """Weights by bucket, one column for each family and each pair of languages."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    slope: np.ndarray


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a text, in order."""
    data = b" " + text.lower().encode("utf-8", "surrogatepass").translate(LETTERS) + b"  "
    at = np.frombuffer(data, dtype=np.uint8).astype(np.uint32)
    code = at[:-2] << 16 | at[1:-1] << 8 | at[2:]
    code = code[code != SPACE]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def train_machine(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray) -> np.ndarray:
    """Weights of a linear support vector machine without offset, averaged over the last half."""
    rng = np.random.default_rng(SEED)
    weights, mean = np.zeros(BUCKETS), np.zeros(BUCKETS)
    scale, step, kept = 1.0, 0, 0
    share = {s: len(sign) / (2 * max(1, int((sign == s).sum()))) for s in (-1, 1)}
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            step += 1
            rate = 1 / (REGULAR * (step + 1 / REGULAR))
            at, value = rows[i]
            margin = sign[i] * scale * float(weights[at] @ value)
            scale *= 1 - rate * REGULAR
            if margin < 1:
                weights[at] += rate * share[int(sign[i])] * sign[i] / scale * value
        if epoch >= EPOCHS // 2:
            mean += scale * weights
            kept += 1
    return mean / max(kept, 1)


def unit(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The counts of a text's buckets, scaled to length one."""
    at, counts = np.unique(codes, return_counts=True)
    return at, counts / np.sqrt((counts.astype(float) ** 2).sum())


def train(texts: list[str], languages: list[str]) -> Model | None:
    """Machines for families, and for pairs of languages within a family."""
    codes = [trigrams(text) for text in texts]
    known = [i for i, found in enumerate(codes) if len(found)]
    if not known:
        return None
    rows = [unit(codes[i]) for i in known]
    lang = np.array([languages[i] for i in known])
    family = np.array([FAMILIES.get(x, x) for x in lang])
    families = sorted(set(family.tolist()))
    members = {f: sorted(set(lang[family == f].tolist())) for f in families}
    pairs = [pair for f in families for pair in combinations(members[f], 2)]
    parts = [(np.arange(len(rows)), np.where(family == f, 1, -1)) for f in families]
    for one, two in pairs:
        at = np.flatnonzero((lang == one) | (lang == two))
        parts.append((at, np.where(lang[at] == one, 1, -1)))
    columns, slopes = [], []
    for at, sign in parts:
        weights = train_machine([rows[i] for i in at], sign)
        margins = np.array([weights[codes[known[i]]].mean() for i in at])
        columns.append(weights)
        slopes.append(3 / max(float(np.median(np.abs(margins))), 1e-9))
    return Model(families, members, pairs, np.array(columns, dtype=np.float32).T.copy(), np.array(slopes))


def probability(margin: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def predict(text: str, model: Model | None) -> tuple[str, float]:
    """The language of one text and how sure the machines on its way are."""
    if model is None or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    margins = model.weights[trigrams(text)].mean(0) * model.slope
    n = len(model.families)
    best = int(np.argmax(margins[:n]))
    family = model.families[best]
    score = float(probability(margins[best])) if n > 1 else 1.0
    members = model.members[family]
    votes = {x: [0, 0.0] for x in members}
    for (one, two), margin in zip(model.pairs, margins[n:].tolist()):
        if one in votes:
            for x, m in ((one, margin), (two, -margin)):
                votes[x][0] += m > 0
                votes[x][1] += m
    chosen = max(members, key=lambda x: (*votes[x], x))
    for (one, two), margin in zip(model.pairs, margins[n:].tolist()):
        if chosen in (one, two) and one in votes:
            score = min(score, float(probability(margin if chosen == one else -margin)))
    return chosen, score


def learned(documents: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from a bounded sample of each language outside the held-out fold."""
    known = documents.select("doc_id", F.col("lang").alias("label")).where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull()
    )
    known = known.where(remainder(F.col("doc_id"), FOLDS) != HELD)
    # The model grows with the languages, and the table may name any number of them.
    often = known.groupBy("label").agg(F.count(F.lit(1)).alias("of")).orderBy(F.desc("of"), "label")
    known = known.join(F.broadcast(often.limit(LANGUAGES).select("label")), "label", "left_semi")
    ids = sample_ids(known, per_language)
    if not ids:
        return None
    rows = rows_of(documents, ids, "string").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in rows], [r["label"] for r in rows])


def language(documents: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [predict(text, held.value) for text in texts_of(batch)]
        columns = [
            batch.column("doc_id"),
            pa.array([x for x, _ in found], pa.string()),
            pa.array([x for _, x in found], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    named = by_batch(documents.select("doc_id", "text"), compute, "doc_id long, lang_pred string, score double")
    return named.select(
        "doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score"
    )


def language_id(documents: DataFrame) -> DataFrame:
    return language(documents, learned(documents))


def known_language(documents: DataFrame, model: Model | None, least: float = LEAST_SCORE) -> DataFrame:
    """The documents, with all their columns, whose language is told with a score of ``least`` or more."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def keep(texts: list[str]) -> list[bool]:
        found = (predict(text, held.value) for text in texts)
        return [name != UNKNOWN and score >= least for name, score in found]

    return filtered(documents, keep)
