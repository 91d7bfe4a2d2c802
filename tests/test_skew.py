"""A third of the rows on one key: the join is split, not done by one task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioscan.operators import audience, dedup, diff, render

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
    "spark.sql.shuffle.partitions": "16",
}
ROWS = 30000


@pytest.fixture
def small_limits(spark):
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def skewed(spark):
    """Ids from 0, of which each third one has the hot key 0."""
    ids = spark.range(ROWS, numPartitions=8)
    return ids.withColumn("key", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))


def final_plan(df, rows) -> str:
    assert len(df.collect()) == rows
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_copies(spark, small_limits):
    texts = skewed(spark).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "key").alias("text"))
    assert "skew=true" in final_plan(dedup.exact_copies(texts), ROWS // 3 - 1)


def test_render(spark, small_limits):
    sends = skewed(spark).select(
        F.col("id").alias("recipient_id"), F.col("key").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("url")
    )
    docs = skewed(spark).select(F.col("id").alias("doc_id"), F.lit("{{url}}").alias("html"))
    assert "skew=true" in final_plan(render.render(sends, docs, {"url": "url"}), ROWS)


def test_replies(spark, small_limits):
    rows = skewed(spark).select(
        F.col("key").alias("user_id"), (F.lit(1700000000) + F.col("id")).cast("timestamp").alias("ts")
    )
    replies = audience.reply_within(rows, rows, 48)
    assert "skew=true" in final_plan(replies, 1)


def test_families(spark, small_limits):
    links = skewed(spark).where("id > 0 AND key = 0").select(F.col("key").alias("a"), F.col("id").alias("b"))
    family = dedup.linked_families(links)
    assert family.where("family = 0").count() == ROWS // 3


def test_a_third_of_all_documents_near_copies(spark, small_limits, monkeypatch):
    """Near copies and families of a hot group; the pairs compared stay about as many as documents."""
    compared = []
    compare = dedup._compared
    monkeypatch.setattr(dedup, "_compared", lambda pairs, sets: compared.append(pairs.count()) or compare(pairs, sets))
    common = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.concat(F.lit("w"), i)), " ")
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("d"), "id", F.lit("x"), i)), " ")
    texts = spark.range(1500, numPartitions=4).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.concat(common, F.lit(" d"), "id")).otherwise(own).alias("text"),
    )
    assert dedup.version_family(texts).where("family = 0").count() == 500
    assert sum(compared) < 1500


def test_line_changes(spark, small_limits):
    pairs = skewed(spark).where("id > 0").select(F.col("key").alias("a"), F.col("id").alias("b"))
    texts = spark.range(ROWS).select(F.col("id").alias("doc_id"), F.concat(F.lit("line "), "id").alias("text"))
    changes = diff.line_changes(texts, pairs)
    assert "skew=true" in final_plan(changes, 2 * (ROWS // 3 - 1))
