"""From raw documents to packed training sequences, stage by stage.

1. Language: documents whose language is not told go, those without letters. Scores under
   one half go too; it takes three or more families, or three languages of one, to give them.
2. Quality: documents that the base rule or a learned rule rejects go.
3. Similarity: of documents linked by word shingles one stays.
4. Decontamination: documents that repeat a benchmark item go.
5. Packing: what is left is cut into pieces and packed into sequences.

Every stage but the last returns the columns of ``documents``. A null text is
empty: it has no language, so it goes in the first stage. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import decontaminate, langid, ngram_join, packing, quality_rules
from folioscan.llm.common import table
from folioscan.llm.queries import vocabulary
from folioscan.session import staged

#: Documents with so many hundredths of their shingles of so many words in common are near copies;
#: op4 has numbers of its own.
NEAR_SIZE, NEAR_SHARE = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.known_language(docs, langid.learned(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = quality_rules.learned_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.kept_by_rules(docs, rules)


def similarity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs, NEAR_SIZE, NEAR_SHARE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_repeated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("language ID", language),
    ("quality rules", quality),
    ("n-gram Jaccard join", similarity),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed),
]

#: Learned models and token ids cannot be written in SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
