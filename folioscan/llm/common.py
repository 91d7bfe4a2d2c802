"""What several operators share: tables, folds, words and batches of text."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Rows that Python works on at a time, and bytes, if rows are long.
ROWS, BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; -1 for a missing id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1))


def labels_of(labels: DataFrame, label: str, n: int = 1, held: int = -2) -> DataFrame:
    """``doc_id, label``: the labels that may be learned from, once for each id.

    Ids in the held-out remainder are left out. Where an id has several labels,
    the highest counts; null ids and labels are dropped.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .where(remainder(F.col("doc_id"), n) != held)
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
    )


def sample_ids(rows: DataFrame, per_label: int) -> dict:
    """``{doc_id: label}`` of at most ``per_label`` ids of each label, by a hash of the id.

    A threshold on the hash cuts the rows down where they are; only about as many ids
    as the bound allows reach the driver, each of them once however many rows it has.
    """
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30))
    # Counted to two hundredths, which the margin of the threshold covers several times over.
    counted = rows.groupBy("label").agg(F.approx_count_distinct("doc_id", 0.02).alias("ids"))
    counts = {r["label"]: r["ids"] for r in counted.collect() if r["ids"]}
    if not counts:
        return {}
    most = F.lit(0.0)
    for label, count in counts.items():
        most = F.when(F.col("label") == label, F.lit((1 << 30) * per_label * 1.25 / count)).otherwise(most)
    drawn = rows.select("doc_id", "label", draw.alias("draw")).where(F.col("draw") < most)
    found = drawn.distinct().collect()
    kept: dict = {}
    for row in sorted(found, key=lambda r: (r["draw"], str(r["doc_id"]))):
        kept.setdefault(row["label"], {})[row["doc_id"]] = None
    return {doc_id: label for label, ids in kept.items() for doc_id in list(ids)[:per_label]}


def rows_of(documents: DataFrame, ids: dict, kind: str) -> DataFrame:
    """One text of each id of a sample with its label; the sample is bounded, so it is broadcast.

    Of an id with several texts the least one counts, so that ids bound the rows too.
    """
    spark = documents.sparkSession
    wanted = spark.createDataFrame(list(ids.items()), f"doc_id long, label {kind}")
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "label")
    return found.agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def by_batch(
    df: DataFrame, compute: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType
) -> DataFrame:
    """Apply ``compute`` to the rows of each partition, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield compute(batch)

    return df.mapInArrow(run, schema)


def slices(
    batches: Iterator[pa.RecordBatch], most: int = ROWS, size: int = BYTES
) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of ``most`` rows or about ``size`` bytes; what a task used is given back at its end.

    Whole batches of long texts would be held several times over, as Arrow data and
    as Python objects, and a worker goes on to other tasks with the memory it took.
    """
    for batch in batches:
        rows = max(1, min(most, size * batch.num_rows // max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def give_back() -> None:
    """Return free memory to the system; a worker lives on and others need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [value or "" for value in batch.column(column).to_pylist()]


def filtered(df: DataFrame, keep: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows, with all their columns, whose text ``keep`` is true for; null text is empty."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(keep(texts_of(batch)), pa.bool_()))

    return by_batch(df, compute, df.schema)
