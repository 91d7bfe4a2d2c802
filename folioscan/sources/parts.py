"""A stored corpus of which only the parts that changed are written again.

The corpus is a parquet table in parts: a column's value, and a slice by a hash of the id.
Every document is stored with a digest of all its columns. To bring the table up to date, the
digests of each part are added up on both sides, in tasks, and compared; parts that differ are
overwritten, parts without documents are deleted, and all others are left alone. Stored texts
are not read for it: only the two digest columns are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscan.session import staged
from folioscan.sources.files import PART, part_of

SLICE = "part_slice"
DIGESTS = ("digest_one", "digest_two")


def in_parts(docs: DataFrame, by: str, slices: int) -> DataFrame:
    """``docs`` with its digests and the columns it is partitioned by."""
    columns = [F.col(name) for name in docs.columns]
    present = [column.isNull() for column in columns]
    part = {
        # Nulls leave a hash as it is, so that it is told apart which columns are null.
        DIGESTS[0]: F.xxhash64(*columns, *present),
        DIGESTS[1]: F.xxhash64(F.lit(1), *columns, *present),
        PART + by: part_of(F.col(by)),
        SLICE: F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(slices)).cast("int"),
    }
    return docs.withColumns(part)


def part_sums(rows: DataFrame, by: str, name: str) -> DataFrame:
    """A row for each part: its documents, and their digests added up, equal rows counted."""
    one, two = (F.col(column) for column in DIGESTS)
    # A sum counts repeated rows, which a xor alone would cancel out.
    total = F.sum(one.cast("decimal(38,0)")).cast("string")
    return rows.groupBy(PART + by, SLICE).agg(
        F.count(F.lit(1)).alias(f"{name}_docs"),
        F.concat_ws(":", total, F.bit_xor(two).cast("string")).alias(f"{name}_sum"),
    )


def changes(docs: DataFrame, path: str, by: str = "lang", slices: int = 1) -> DataFrame:
    """``part_<by>, part_slice, old_docs, new_docs, state`` of every part: new, changed, gone or same."""
    spark = docs.sparkSession
    keys = [PART + by, SLICE]
    rows = in_parts(docs, by, slices)
    new = part_sums(rows, by, "new")
    if not exists(spark, path):
        found = new.withColumns({"old_docs": F.lit(None).cast("long"), "old_sum": F.lit(None).cast("string")})
    else:
        stored = spark.read.schema(rows.schema).parquet(path).select(*keys, *DIGESTS)
        found = part_sums(stored, by, "old").join(new, keys, "full_outer")
    state = (
        F.when(F.col("old_docs").isNull(), "new")
        .when(F.col("new_docs").isNull(), "gone")
        .when(F.col("old_sum") == F.col("new_sum"), "same")
        .otherwise("changed")
    )
    return found.select(
        *keys,
        F.coalesce("old_docs", F.lit(0)).alias("old_docs"),
        F.coalesce("new_docs", F.lit(0)).alias("new_docs"),
        state.alias("state"),
    )


def update_docs(docs: DataFrame, path: str, by: str = "lang", slices: int = 1) -> DataFrame:
    """Make the table at ``path`` hold ``docs``, writing changed parts only; returns :func:`changes`.

    Slices make parts smaller, so that one changed document costs less; they are fixed by
    the first write. A part is replaced when its rows are written, not before.
    """
    spark = docs.sparkSession
    keys = [PART + by, SLICE]
    found = staged(changes(docs, path, by, slices), "changes")
    written = found.where(F.col("state").isin("new", "changed"))
    if not written.isEmpty():
        rows = in_parts(docs, by, slices).join(written.select(*keys), keys, "left_semi")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    gone = found.where(F.col("state") == "gone")
    if not gone.isEmpty():
        # Folders as they are named on disk, escaped, of the parts that hold no document any more.
        folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")
        folders = spark.read.parquet(path).select(*keys, folder).distinct()
        for row in folders.join(gone.select(*keys), keys, "left_semi").toLocalIterator():
            delete(spark, row["folder"])
    return found


def read_parts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The documents of a stored corpus, with the columns of ``schema`` and those of its parts, to filter by."""
    stored = spark.read.parquet(path)
    parts = [name for name in stored.columns if name.startswith(PART) and name not in schema.fieldNames()]
    return stored.select(*schema.fieldNames(), *parts)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(path))
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
