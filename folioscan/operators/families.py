"""Families of versions that are kept, and that new documents join.

``version_family`` reads a whole corpus. Here what it takes to compare a new document with
all earlier ones is stored, so that earlier texts are not read again:

- ``sets``: the shingles of each document;
- ``roots``: each linked document and the first document of its family.

A delivery shuffles short keys of the sets, earlier ones too, which tell the new documents that
may have a similar one and the earlier documents that they may be similar to (see
:func:`dedup.prefix_keys`; the order of hashes is the same for all deliveries). Only these are
ordered and compared, and families that are known already are not looked for again.

Deliveries are appended; no stored row is rewritten but those of ``roots``, a pair of ids
each, of which a new version is written beside the old. It is written last: a delivery that
broke off may be given again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.operators.components import components, with_links
from folioscan.operators.dedup import SHINGLE_WORDS, _members, _shingle_sets, family_links, only, prefix_keys
from folioscan.session import staged


def start(texts: DataFrame, path: str, threshold: float = 0.5, k: int = SHINGLE_WORDS) -> DataFrame:
    """Store the families of a first delivery in an empty folder; ``doc_id, family`` as ``version_family``."""
    return _deliver(texts, path, 0, threshold, k)


def add(texts: DataFrame, path: str, delivery: int, threshold: float = 0.5, k: int = SHINGLE_WORDS) -> DataFrame:
    """Store a further delivery, numbered from 1, and return all families as they are now.

    Equal to ``version_family`` over all documents delivered so far. Ids must be new.
    """
    if delivery < 1:
        raise ValueError("deliveries after the first are numbered from 1")
    return _deliver(texts, path, delivery, threshold, k)


def families(spark: SparkSession, path: str, delivery: int) -> DataFrame:
    """``doc_id, family`` as they were after a delivery."""
    roots = spark.read.parquet(f"{path}/roots/delivery={delivery}")
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("family"))


def _deliver(texts: DataFrame, path: str, delivery: int, threshold: float, k: int) -> DataFrame:
    spark = texts.sparkSession
    kept = f"{path}/roots/delivery={delivery}"
    place = spark._jvm.org.apache.hadoop.fs.Path(kept)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise ValueError(f"delivery {delivery} is stored already")
    members = staged(_members(texts, k), "members")
    heads = members.where(F.col("doc_id") == F.col("head")).select("doc_id")
    copies = members.where(F.col("doc_id") != F.col("head")).select(
        F.col("head").alias("a"), F.col("doc_id").alias("b")
    )
    _shingle_sets(only(texts, heads), k).write.mode("overwrite").parquet(f"{path}/sets/delivery={delivery}")
    stored = spark.read.parquet(f"{path}/sets").where(F.col("delivery") <= delivery)
    company = only(stored, _company(stored, delivery, threshold)).select("doc_id", "n", "shingles")
    sets = staged(company, "sets")
    if delivery:
        roots = spark.read.parquet(f"{path}/roots/delivery={delivery - 1}")
        links = family_links(sets, threshold, roots).unionByName(copies)
        found = with_links(roots, staged(links, "links"))
    else:
        found = components(family_links(sets, threshold).unionByName(copies))
    found.write.parquet(kept)
    return families(spark, path, delivery)


def _company(stored: DataFrame, delivery: int, threshold: float) -> DataFrame:
    """``doc_id`` of new documents that may be similar to any, and of earlier ones that may be to a new one."""
    keys, least = prefix_keys(F.col("shingles"), F.col("n"), threshold)
    listed = stored.select(
        "doc_id", least.alias("least"), (F.col("delivery") == delivery).alias("fresh"), F.explode(keys).alias("key")
    )
    same = Window.partitionBy("key")
    met = listed.withColumns(
        {"low": F.min("doc_id").over(same), "high": F.max("doc_id").over(same), "any": F.max("fresh").over(same)}
    )
    counted = (
        met.where((F.col("low") != F.col("high")) & F.col("any"))
        .groupBy("doc_id", "least")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    return counted.where(F.col("shared") >= F.col("least")).select("doc_id")
