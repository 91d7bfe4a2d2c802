"""Quality rules as a learned decision list.

Sequential covering: a rule for bad documents grows by the threshold condition
of highest information gain on two thirds of the labelled sample, is pruned
backwards on the other third, and is kept if it is precise there. What it covers
is set aside, and the next rule is grown. The ordered rules become one
conditional expression of Spark over the statistics of a text.

Texts that are null or have no words fail the base rule. Without labels of both
kinds no rule is learned and the base rule alone decides. Repeated rows are
judged one by one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from functools import reduce
from operator import and_
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import labels_of, rows_of, sample_ids
from folioscan.llm.text_stats import COUNTS, SHARES, text_stats

#: Bound of the labelled sample, for each label.
PER_LABEL = 6000
#: Fewest words, and the largest share of words in repeated windows, in hundredths.
LEAST_WORDS = 10
MOST_REPEATED = 20
#: A rule is kept if so much of what it covers in the pruning set is bad.
PRECISION = 0.95
CUTS = 64
LONGEST = 4

FEATURES = ("n_words", *SHARES)


class Condition(NamedTuple):
    """``feature >= threshold``, or ``feature <= threshold``."""

    feature: str
    above: bool
    threshold: int

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        values = rows[self.feature]
        return values >= self.threshold if self.above else values <= self.threshold

    def column(self, prefix: str = "") -> Column:
        value = F.col(prefix + self.feature)
        return value >= self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, rows: dict[str, np.ndarray]) -> np.ndarray:
    held = np.ones(len(rows["n_words"]), dtype=bool)
    for condition in rule:
        held &= condition.holds(rows)
    return held


def candidates(rows: dict[str, np.ndarray], at: np.ndarray) -> list[Condition]:
    """Thresholds at quantiles of the bad rows that a rule still covers."""
    found = []
    for feature in FEATURES:
        values = rows[feature][at]
        for threshold in np.unique(np.quantile(values, np.linspace(0, 1, CUTS), method="nearest")):
            found += [Condition(feature, above, int(threshold)) for above in (True, False)]
    return found


def gain(bad: int, good: int, bad_before: int, good_before: int) -> float:
    """FOIL's information gain."""
    if not bad:
        return 0.0
    return bad * (np.log2(bad / (bad + good)) - np.log2(bad_before / (bad_before + good_before)))


def grow(rows: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the best condition until no good row is covered."""
    rule: Rule = ()
    held = np.ones(len(bad), dtype=bool)
    while len(rule) < LONGEST and (held & ~bad).any():
        n_bad, n_good = int((held & bad).sum()), int((held & ~bad).sum())
        best, most = None, 1e-9
        for condition in candidates(rows, held & bad):
            now = held & condition.holds(rows)
            gained = gain(int((now & bad).sum()), int((now & ~bad).sum()), n_bad, n_good)
            if gained > most:
                best, most = condition, gained
        if best is None:
            break
        rule, held = (*rule, best), held & best.holds(rows)
    return rule


def worth(rule: Rule, rows: dict[str, np.ndarray], bad: np.ndarray) -> tuple[float, int]:
    held = covers(rule, rows)
    n_bad, n_good = int((held & bad).sum()), int((held & ~bad).sum())
    return ((n_bad - n_good) / (n_bad + n_good) if n_bad + n_good else -1.0), n_bad


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, ids: np.ndarray) -> list[Rule]:
    """Ordered rules for bad rows."""
    pruning = np.array([zlib.crc32(f"prune {i}".encode()) % 3 == 0 for i in ids], dtype=bool)
    part = lambda at: ({k: v[at] for k, v in rows.items()}, bad[at])
    (grown, grown_bad), (pruned, pruned_bad) = part(~pruning), part(pruning)
    rules: list[Rule] = []
    while grown_bad.any() and pruned_bad.any():
        rule = grow(grown, grown_bad)
        if not rule:
            break
        shorter = [rule[:n] for n in range(1, len(rule) + 1)]
        rule = max(shorter, key=lambda r: worth(r, pruned, pruned_bad))
        share, n_bad = worth(rule, pruned, pruned_bad)
        if share < 2 * PRECISION - 1 or not n_bad:
            break
        rules.append(rule)
        left, pruned_left = ~covers(rule, grown), ~covers(rule, pruned)
        grown, grown_bad = {k: v[left] for k, v in grown.items()}, grown_bad[left]
        pruned, pruned_bad = {k: v[pruned_left] for k, v in pruned.items()}, pruned_bad[pruned_left]
    return rules


def verdict(rules: list[Rule], prefix: str = "") -> Column:
    """The decision list: false for the first rule that holds, true where none does."""
    decided: Column = F.lit(True)
    for rule in reversed(rules):
        held = reduce(and_, (condition.column(prefix) for condition in rule))
        decided = F.when(held, F.lit(False)).otherwise(decided)
    return decided


def learned_rules(documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> list[Rule]:
    """Rules from a bounded sample of labelled documents."""
    ids = sample_ids(labels_of(labels, "quality"), per_label)
    if len(set(ids.values())) < 2:
        return []
    found = text_stats(rows_of(documents, ids, "int"), "doc_id", "label").collect()
    found.sort(key=lambda row: row["doc_id"])
    rows = {name: np.array([row[name] for row in found], dtype=np.int64) for name in FEATURES}
    if not found:
        return []
    bad = np.array([row["label"] == 0 for row in found], dtype=bool)
    return learn(rows, bad, np.array([row["doc_id"] for row in found]))


def base_failed(prefix: str = "") -> Column:
    """Whether a text has too few words, or too many of them in repeated windows."""
    n_words = F.col(prefix + "n_words")
    return (n_words < LEAST_WORDS) | (100 * F.col(prefix + "n_repeat_words") > MOST_REPEATED * n_words)


def apply_rules(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed`` and ``kept``."""
    failed = base_failed()
    return text_stats(documents, "doc_id").select(
        "doc_id", *COUNTS, failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept")
    )


def kept_by_rules(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The documents, with all their columns, that base rule and learned rules keep."""
    prefix = "_stat_"
    found = text_stats(documents, *documents.columns, prefix=prefix)
    return found.where(~base_failed(prefix) & verdict(rules, prefix)).select(*documents.columns)


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its statistics and whether base rule and learned rules keep it."""
    return apply_rules(documents, learned_rules(documents, labels))
