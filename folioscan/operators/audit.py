"""Checks every mailing has to pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import patterns as P
from folioscan.functions.columns import all_matches
from folioscan.operators.extract import lang_of, subject_of, title_of, with_markup

RULES = ("has_title", "has_lang", "has_preheader", "has_unsubscribe", "images_have_alt")


def has_alt(tag: Column) -> Column:
    """Whether an image tag has ``alt``, be it without a value; quoted values are emptied first."""
    return F.regexp_replace(tag, P.QUOTED, '""').rlike(P.has_attribute("alt"))


def audit(docs: DataFrame) -> DataFrame:
    """One boolean per rule and document; row-local. Comments and scripts satisfy no rule."""
    plain = F.col("markup")
    return with_markup(docs).select(
        "doc_id",
        (title_of(plain) != "").alias("has_title"),
        (lang_of(plain) != "").alias("has_lang"),
        F.exists(all_matches(plain, P.tag_edges("div"), 0), lambda mark: mark.rlike(P.HIDDEN)).alias("has_preheader"),
        plain.rlike(P.UNSUBSCRIBE_TAG).alias("has_unsubscribe"),
        F.forall(all_matches(plain, P.IMG, 0), has_alt).alias("images_have_alt"),
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    """One row: documents, and how many of them fail each rule."""
    return audit.agg(
        F.count("*").alias("n_docs"),
        *(F.count_if(~F.col(rule)).alias(f"fail_{rule}") for rule in RULES),
    )


def metadata_drift(docs: DataFrame) -> DataFrame:
    """``doc_id, subject, title`` where the subject noted in the comment is not the title.

    Both come from the same row, so no join is needed. Rows are dropped by
    unfolding an array of one pair or none: a filter would be moved below the
    projection and match the patterns a second time.
    """
    pair = F.struct(subject_of(F.col("html")).alias("subject"), title_of(F.col("markup")).alias("title"))
    drifted = F.filter(
        F.array(pair), lambda p: (p["subject"] != "") & (p["subject"] != p["title"])
    )
    return with_markup(docs, "html").select("doc_id", F.inline(drifted))
