"""Toxicity by embeddings of subwords, averaged into a linear softmax.

A word is the mean of the vectors of its byte n-grams, a text the mean of its
words; vectors and softmax are trained together. Misspelt words share n-grams
with the words they were made from, so they are near them unseen. Because all is
linear after training, an n-gram's part in the outcome is one number, and that of
a word is kept once it is worked out.

N-grams that few training texts have keep the vector zero, so that chance strings
say nothing.

Null and empty texts get the score of a text without any sign, the model's offset.
Without labels of both kinds every score is 0. Rows are scored one by one, repeated ones
alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import by_batch, labels_of, remainder, rows_of, sample_ids, texts_of

FOLDS, HELD = 4, 2
#: Bound of the labelled sample, for each label.
PER_LABEL = 2500
LIMIT = 0.3
DIMENSIONS = 8
BUCKETS = 1 << 18
SIZES = (3, 4, 5, 6)
#: Share of the training texts that an n-gram must be in.
LEAST_SHARE = 1 / 400
EPOCHS = 4
RATE = 1.5
DECAY = 1e-3
#: Share of toxic texts that the scores are calibrated to.
BASE_RATE = 0.1
SEED = 5
KEPT_WORDS = 600_000

#: Marks and digits around words read as space; letters and other bytes stay.
MARKS = bytes(32 if chr(b) in "\t\n\v\f\r.,;:!?\"()[]{}#*%&|<>/\\~^+=_-" else b for b in range(256))


class Model(NamedTuple):
    """Each bucket's part in the calibrated margin, and the offset."""

    parts: np.ndarray
    offset: float


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(MARKS).split()


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word and the bucket of every n-gram of ``<word>``."""
    data = np.frombuffer(b"".join(b"<%b>" % word for word in words), dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    owners, buckets = [], []
    code = np.zeros(len(data), dtype=np.uint64)
    for n in range(1, max(SIZES) + 1):
        if n > len(data):
            break
        code = code[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :]
        if n in SIZES:
            inside = owner[: len(code)] == owner[n - 1 :]
            mixed = (code[inside] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            owners.append(owner[: len(code)][inside])
            buckets.append((mixed >> np.uint64(64 - 18)).astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets)


def word_parts(words: list[bytes], parts: np.ndarray) -> np.ndarray:
    """Each word's part in the margin: the mean over its n-grams."""
    owner, bucket = ngrams(words)
    counts = np.bincount(owner, minlength=len(words))
    return np.bincount(owner, weights=parts[bucket], minlength=len(words)) / np.maximum(counts, 1)


def bag(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights, which sum to one."""
    counts = Counter(words)
    owner, bucket = ngrams(list(counts))
    often = np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) / len(words)
    share = often / np.bincount(owner, minlength=len(counts))
    at, inverse = np.unique(bucket, return_inverse=True)
    return at.astype(np.int32), np.bincount(inverse, weights=share[owner]).astype(np.float32)


class Trainer:
    """Vectors of n-grams and the softmax above them, by steps scaled per vector."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        self.vectors = np.zeros((BUCKETS, DIMENSIONS), dtype=np.float32)
        self.softmax = rng.normal(0, 1, (DIMENSIONS, 2))
        self.offset = np.zeros(2)
        self.seen = np.full(BUCKETS, 1e-8, dtype=np.float32)
        self.seen_softmax = 1.0

    def step(self, text: tuple[np.ndarray, np.ndarray], label: int, rate: float) -> None:
        at, weight = text
        mean = weight @ self.vectors[at]
        found = mean @ self.softmax + self.offset
        chance = np.exp(found - found.max())
        wrong = chance / chance.sum() - np.eye(2)[label]
        back = (self.softmax @ wrong).astype(np.float32)
        slope = np.outer(mean, wrong)
        self.seen_softmax += float((slope**2).sum())
        self.seen[at] += weight**2 * float(back @ back)
        pace = rate / np.sqrt(self.seen[at])
        self.vectors[at] *= 1 - DECAY * rate
        self.vectors[at] -= (pace * weight)[:, None] * back
        self.softmax -= 0.1 * rate * slope / np.sqrt(self.seen_softmax)
        self.offset -= 0.05 * rate * wrong


def train(texts: list[str], labels: list[int]) -> Model | None:
    """Train vectors and softmax together, text by text; every fifth text calibrates the margin."""
    rows = [(bag(words), label) for text, label in zip(texts, labels) if (words := words_of(text))]
    if len({label for _, label in rows}) < 2:
        return None
    texts_with = np.bincount(np.concatenate([at for (at, _), _ in rows]), minlength=BUCKETS)
    often = texts_with >= max(2, LEAST_SHARE * len(rows))
    rows = [((at[often[at]], weight[often[at]]), label) for (at, weight), label in rows]
    trainer = Trainer()
    rng = np.random.default_rng(SEED)
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            if i % 5:
                trainer.step(*rows[i], RATE * (1 - epoch / EPOCHS))
    parts = trainer.vectors @ (trainer.softmax[:, 1] - trainer.softmax[:, 0])
    aside = rows[::5] if len({label for _, label in rows[::5]}) == 2 else rows
    margins = np.array([float(parts[at] @ weight) for (at, weight), _ in aside])
    slope, offset = calibrated(margins, np.array([label for _, label in aside]))
    return Model((slope * parts).astype(np.float32), offset)


def calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins, by damped Newton steps."""
    share = labels.mean()
    weight = np.where(labels == 1, BASE_RATE / share, (1 - BASE_RATE) / (1 - share))
    middle, spread = margins.mean(), margins.std() + 1e-9
    rows = np.stack([(margins - middle) / spread, np.ones(len(margins))])
    found = np.array([1.0, 0.0])
    for _ in range(300):
        chance = 1 / (1 + np.exp(-np.clip(found @ rows, -40, 40)))
        slope = rows @ (weight * (chance - labels)) + 1e-3 * found
        bend = (rows * (weight * chance * (1 - chance) + 1e-9)) @ rows.T + 1e-3 * np.eye(2)
        found = found - 0.3 * np.linalg.solve(bend, slope)
    return float(found[0] / spread), float(found[1] - found[0] * middle / spread)


class Scorer:
    """Scores texts; keeps the parts of words that recur."""

    def __init__(self, model: Model):
        self.model = model
        self.kept: dict[bytes, float] = {}

    def scores(self, texts: list[str]) -> list[float]:
        cut = [words_of(text) for text in texts]
        fresh = [word for word in set().union(*cut) if word not in self.kept]
        if len(self.kept) + len(fresh) > KEPT_WORDS:
            self.kept.clear()
            fresh = list(set().union(*cut))
        if fresh:
            self.kept.update(zip(fresh, word_parts(fresh, self.model.parts).tolist()))
        return [self.score(words) for words in cut]

    def score(self, words: list[bytes]) -> float:
        mean = sum(map(self.kept.__getitem__, words)) / len(words) if words else 0.0
        return float(1 / (1 + np.exp(-np.clip(mean + self.model.offset, -40, 40))))


def blocks(texts: list[str], together: int = 1 << 21) -> list[list[str]]:
    """Runs of texts of about so many characters."""
    found, size = [[]], 0
    for text in texts:
        if size > together:
            found.append([])
            size = 0
        found[-1].append(text)
        size += len(text)
    return found


def learned(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model | None:
    """A model from a bounded sample of labelled documents outside the held-out fold."""
    ids = sample_ids(labels_of(labels, "toxic", FOLDS, HELD), per_label)
    if len(set(ids.values())) < 2:
        return None
    rows = rows_of(documents, ids, "int").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return train([r["text"] for r in rows], [r["label"] for r in rows])


def score(documents: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text."""
    held = documents.sparkSession.sparkContext.broadcast(model)
    scorer: list[Scorer] = []

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        if held.value is None:
            found = [0.0] * len(texts)
        else:
            if not scorer:
                scorer.append(Scorer(held.value))
            found = [x for block in blocks(texts) for x in scorer[0].scores(block)]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"]
        )

    scored = by_batch(documents.select("doc_id", "text"), compute, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= LIMIT).cast("int").alias("predicted"),
    )


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, learned(documents, labels))
