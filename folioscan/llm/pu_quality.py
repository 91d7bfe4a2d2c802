"""Quality scores by learning from positive and unlabelled documents.

Trusted positives are documents labelled good; everything else is unlabelled web
text of which an unknown share, the class prior, is good. The prior is estimated
from a first model that tells positives from unlabelled: among its top scores the
ratio of both distributions is lowest where only good documents are left. A small
network over text statistics then minimises the non-negative unbiased risk: the
risk of the negatives is the unlabelled risk less the positives' part of it, and
never falls below zero.

Null and empty texts get a score like any other. Without positives or unlabelled
documents every score is 0.5. Rows are scored one by one, repeated ones alike; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import by_batch, labels_of, remainder, rows_of, sample_ids, texts_of
from folioscan.llm.text_stats import COUNTS, SHARES, stats

#: Held out: remainder of the id's checksum.
FOLDS, HELD = 3, 1
#: Bounds of the samples of positives and of unlabelled documents.
POSITIVES = 6000
UNLABELLED = 9000
HIDDEN = 16
EPOCHS = 60
BATCH = 512
STEP = 0.01
SEED = 7


def features(texts: list[str]) -> np.ndarray:
    """Logarithms of the counts and the shares of each text."""
    rows = np.array([stats(text) for text in texts], dtype=np.float64)
    return np.log1p(rows.reshape(-1, len(COUNTS) + len(SHARES)))


class Net:
    """One hidden layer; ``margin`` is above zero for documents that look good."""

    def __init__(self, rows: np.ndarray, rng: np.random.Generator):
        self.mean, self.scale = rows.mean(0), rows.std(0) + 1e-6
        n = rows.shape[1]
        self.weights = [
            rng.normal(0, 1 / np.sqrt(n), (n, HIDDEN)),
            np.zeros(HIDDEN),
            rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
            np.zeros(1),
        ]
        self.first = [np.zeros_like(w) for w in self.weights]
        self.second = [np.zeros_like(w) for w in self.weights]
        self.steps = 0

    def forward(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        scaled = np.clip((rows - self.mean) / self.scale, -8, 8)
        hidden = np.tanh(scaled @ self.weights[0] + self.weights[1])
        return scaled, hidden, hidden @ self.weights[2] + self.weights[3]

    def margin(self, rows: np.ndarray) -> np.ndarray:
        return self.forward(rows)[2]

    def update(self, rows: np.ndarray, slope: Callable) -> None:
        """One step of Adam; ``slope`` gives the derivative of the risk by the margins."""
        scaled, hidden, margin = self.forward(rows)
        by_margin = slope(margin)
        back = np.outer(by_margin, self.weights[2]) * (1 - hidden**2)
        slopes = [scaled.T @ back, back.sum(0), hidden.T @ by_margin, by_margin.sum(keepdims=True)]
        self.steps += 1
        for i, found in enumerate(slopes):
            found = found + 1e-4 * self.weights[i]
            self.first[i] = 0.9 * self.first[i] + 0.1 * found
            self.second[i] = 0.999 * self.second[i] + 0.001 * found**2
            first = self.first[i] / (1 - 0.9**self.steps)
            second = self.second[i] / (1 - 0.999**self.steps)
            self.weights[i] = self.weights[i] - STEP * first / (np.sqrt(second) + 1e-8)


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def risk_slope(margin: np.ndarray, n: int, prior: float) -> np.ndarray:
    """Derivative of the non-negative risk; the first ``n`` margins are of positives."""
    positive, unlabelled = margin[:n], margin[n:]
    as_good = -sigmoid(-positive) / n
    as_bad = sigmoid(positive) / n
    rest = sigmoid(unlabelled) / len(unlabelled)
    negative_risk = np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean()
    if negative_risk >= 0:
        return np.concatenate([prior * (as_good - as_bad), rest])
    return np.concatenate([prior * as_bad, -rest])


def separation_slope(margin: np.ndarray, n: int) -> np.ndarray:
    """Derivative of the logistic loss of positives against unlabelled."""
    positive, unlabelled = margin[:n], margin[n:]
    return np.concatenate([-sigmoid(-positive) / n, sigmoid(unlabelled) / len(unlabelled)])


def fit(positives: np.ndarray, unlabelled: np.ndarray, slope: Callable, epochs: int = EPOCHS) -> Net:
    rng = np.random.default_rng(SEED)
    net = Net(np.concatenate([positives, unlabelled]), rng)
    half = min(BATCH, len(positives), len(unlabelled))
    for _ in range(epochs * max(1, len(unlabelled) // half)):
        one = positives[rng.integers(0, len(positives), half)]
        two = unlabelled[rng.integers(0, len(unlabelled), half)]
        net.update(np.concatenate([one, two]), lambda margin: slope(margin, half))
    return net


def class_prior(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of the unlabelled that is like the positives.

    Half of each kind trains the separating model, the other half is ranked by
    it. Above a threshold stand a share of the positives and of the unlabelled;
    their ratio, with a margin for chance, is lowest where no bad document is left.
    """
    model = fit(positives[::2], unlabelled[::2], separation_slope, epochs=EPOCHS // 3)
    good = np.sort(model.margin(positives[1::2]))
    mixed = np.sort(model.margin(unlabelled[1::2]))
    if not len(good) or not len(mixed):
        return 0.5
    cuts = np.quantile(good, np.linspace(0, 0.9, 91))
    above_good = 1 - np.searchsorted(good, cuts, side="left") / len(good)
    above_mixed = 1 - np.searchsorted(mixed, cuts, side="left") / len(mixed)
    chance = np.sqrt(np.log(200) / 2 / len(good)) + np.sqrt(np.log(200) / 2 / len(mixed))
    best = int(np.argmin((above_mixed + chance) / above_good))
    return float(np.clip(above_mixed[best] / above_good[best], 0.05, 0.95))


def learned(documents: DataFrame, labels: DataFrame) -> Net | None:
    """The scorer from bounded samples outside the held-out fold."""
    good = labels_of(labels, "quality", FOLDS, HELD).where(F.col("label") == 1)
    positive_ids = sample_ids(good, POSITIVES)
    others = documents.where(remainder(F.col("doc_id"), FOLDS) != HELD).where(F.col("doc_id").isNotNull())
    unlabelled_ids = sample_ids(others.select("doc_id", F.lit(0).alias("label")), UNLABELLED)
    if not positive_ids or not unlabelled_ids:
        return None
    both = {i: 2 * (i in positive_ids) + (i in unlabelled_ids) for i in {**positive_ids, **unlabelled_ids}}
    found = rows_of(documents, both, "int")

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = pa.array(features(texts_of(batch)).tolist(), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), rows], ["doc_id", "label", "row"]
        )

    rows = by_batch(found, compute, "doc_id long, label int, row array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["row"]))
    as_array = lambda bit: np.array([r["row"] for r in rows if r["label"] & bit])
    positives, unlabelled = as_array(2), as_array(1)
    if len(positives) < 2 or len(unlabelled) < 2:
        return None
    prior = class_prior(positives, unlabelled)
    return fit(positives, unlabelled, lambda margin, n: risk_slope(margin, n, prior))


def score(documents: DataFrame, model: Net | None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        scores = sigmoid(model.margin(features(texts))) if model else np.full(len(texts), 0.5)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"]
        )

    scored = by_batch(documents.select("doc_id", "text"), compute, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def quality_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, learned(documents, labels))
