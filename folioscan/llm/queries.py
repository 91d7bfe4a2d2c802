"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import (
    chat_format,
    decontaminate,
    hard_negatives,
    html_extract,
    langid,
    ngram_join,
    packing,
    pu_quality,
    quality_rules,
    resampling,
    sentence_pieces,
    token_counts,
    toxicity,
)
from folioscan.llm.common import table

Run = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """The public byte-level BPE that the queries count with; installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_vocabulary() -> str:
    """The public merge-type sentencepiece model, installed on every executor."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = chat_format.with_planted(table(spark, sf_dir, "conversations"))
    return chat_format.digests(chat_format.format_chats(conversations))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.repeated_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = hard_negatives.relabelled(table(spark, sf_dir, "embeddings"))
    return hard_negatives.hard_negatives(embeddings, F.col("vec_id") % 100 == 0)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"), pieces_vocabulary())


QUERIES: dict[str, Run] = {
    run.__name__: run
    for run in (
        op1_toxicity,
        op2_chat_formatting,
        op3_benchmark_decontamination,
        op4_ngram_jaccard_join,
        op5_token_counts,
        op6_quality_rules,
        op7_language_id,
        op8_best_fit_packing,
        op9_quality_classifier,
        op10_html_extraction,
        op11_hard_negatives,
        op12_importance_resampling,
        op13_sentencepiece,
    )
}

SQL: dict[str, str] = {
    "op2_chat_formatting": chat_format.CHECK_SQL,
    "op3_benchmark_decontamination": decontaminate.CHECK_SQL,
    "op11_hard_negatives": hard_negatives.CHECK_SQL,
}
