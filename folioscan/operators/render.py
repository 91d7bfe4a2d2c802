"""Filling the placeholders of a mailing for its recipients."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fill(html: Column, tag: str, value: Column) -> Column:
    """Puts ``value`` in place of ``{{tag}}``; characters of the value mean nothing special."""
    pieces = F.split(html, r"\{\{\s*" + tag.replace(".", r"\.") + r"\s*\}\}", -1)
    return F.call_function("array_join", pieces, F.coalesce(value, F.lit("")))


def render(sends: DataFrame, docs: DataFrame, tags: Mapping[str, str]) -> DataFrame:
    """``recipient_id, doc_id, body`` for ``sends(recipient_id, doc_id, …)``.

    ``tags`` maps a placeholder to the column of ``sends`` that fills it. Every
    recipient has a row; ``body`` is NULL where the document does not exist.
    Recipients meet their document in an equi-join, not a cross join. Spark
    broadcasts the documents where their measured size allows it; beyond that,
    a document sent to a large part of the recipients is split by adaptive
    execution, since documents have one row per id.
    """
    body = F.col("html")
    for tag, column in tags.items():
        body = fill(body, tag, F.col(column).cast("string"))
    return sends.join(docs.select("doc_id", "html"), "doc_id", "left").select(
        "recipient_id", "doc_id", body.alias("body")
    )
