"""Sources and sinks.

The base table of the library is ``docs(doc_id, html)``, one row per document.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscan.session import scratch_path

PART = "part_"
ENDING = r"\.html?$"
#: Files that the driver knows of at once, where folders can be read one after the other.
MOST_FILES = 50_000
#: What holds there: bytes that opening a file counts as, of which Spark's own 4 MB make a task of
#: a few files, and no cache of file lists in the driver.
BY_FOLDERS = {
    "spark.sql.files.openCostInBytes": str(1 << 16),
    "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
}
LISTERS = 8


def read_docs(
    spark: SparkSession, path: str, glob: str = "*.htm*", name: str | None = None, most: int = MOST_FILES
) -> DataFrame:
    """A folder tree of HTML files as ``doc_id, html``.

    The id is the path below ``path`` without its ending, whatever the folders above are
    called, so files of one name in two folders stay apart. ``name`` may be a pattern over the whole path instead;
    its first group is the id. One file is one row and cannot be split, so a corpus
    of many small files is better packed once with :func:`write_docs`. Spark lists
    no files of no bytes, so these have no row here; ``html_files`` reads them.

    Spark lists all files of a table in the driver and keeps what it knows of each. A tree of
    more than ``most`` files is therefore read by folders, as many at a time as hold that many,
    into a table in the shared folder. The files directly in one folder are not divided.
    """
    batches = list(_batches(_folders(spark, path, most), most))
    if len(batches) < 2:
        return _docs(spark, path, [path], glob, name)
    staged = scratch_path(spark, "docs")
    before = {key: spark.conf.get(key) for key in BY_FOLDERS}
    try:
        for key, value in BY_FOLDERS.items():
            spark.conf.set(key, value)
        for paths in batches:
            docs = _docs(spark, path, paths, glob, name)
            docs.write.mode("append").option("compression", "zstd").parquet(staged)
            # The driver's JVM keeps a list of files for as long as Python keeps the table.
            del docs
            gc.collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    return spark.read.schema("doc_id string, html string").parquet(staged)


def _docs(spark: SparkSession, path: str, paths: list[str], glob: str, name: str | None) -> DataFrame:
    """``doc_id, html`` of the files of some ``paths`` below ``path``."""
    files = spark.read.text(paths, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    # The path comes percent-encoded, with plus signs as they are.
    found = F.try_url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
    if name is None:
        # Scheme and authority may be written differently from those of the files; the rest may not.
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        whole = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place)
        root = re.escape(whole.toUri().getPath().rstrip("/") + "/")
        doc_id = F.regexp_replace(F.regexp_replace(found, f"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?{root}", ""), ENDING, "")
    else:
        doc_id = F.regexp_extract(found, name, 1)
    return files.select(doc_id.alias("doc_id"), F.col("value").alias("html"))


def _folders(spark: SparkSession, path: str, most: int) -> list[tuple[str, int]]:
    """Paths below a folder, which together hold all its files, and how many each holds.

    A folder is divided only if it holds more than ``most`` files, and folders besides. None
    where there is nothing to divide. Files are counted by the store, without a list of them.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if re.search(r"[{}\[\]*?\\]", path) or not store.exists(place) or not store.getFileStatus(place).isDirectory():
        return []

    def counted(folder: JavaObject) -> tuple[int, int]:
        summary = store.getContentSummary(folder)
        return summary.getFileCount(), summary.getDirectoryCount()

    found: list[tuple[str, int]] = []
    with ThreadPoolExecutor(LISTERS) as pool:
        left = [place]
        while left:
            inside = [status for folder in left for status in store.listStatus(folder)]
            folders = [s.getPath() for s in inside if s.isDirectory() and not _hidden(s.getPath().getName())]
            found += [(_literal(s.getPath()), 1) for s in inside if not s.isDirectory()]
            left = []
            for folder, (files, below) in zip(folders, pool.map(counted, folders)):
                if files > most and below > 1:
                    left.append(folder)
                else:
                    found.append((_literal(folder), files))
    return found


def _hidden(name: str) -> bool:
    """Whether Spark passes over a folder of this name; one that it is given it reads."""
    marked = name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))
    return marked or name.startswith(".") or name.endswith("._COPYING_")


def _literal(place: JavaObject) -> str:
    """A path that Spark takes for no pattern."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", place.toString())


def _batches(found: list[tuple[str, int]], most: int) -> Iterator[list[str]]:
    """Paths that together hold ``most`` files or fewer; one that holds more is alone."""
    paths: list[str] = []
    held = 0
    for path, files in found:
        if paths and held + files > most:
            yield paths
            paths, held = [], 0
        paths.append(path)
        held += files
    if paths:
        yield paths


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table ``page_id, url, html`` as ``doc_id, html``."""
    return spark.read.parquet(path).select(F.col("page_id").alias("doc_id"), "html")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table of plain documents as ``doc_id, text``."""
    return spark.read.parquet(path).select("doc_id", "text")


def read_written(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What :func:`write_docs` wrote of a table with this schema, unchanged."""
    return spark.read.parquet(path).select(*schema.fieldNames())


def write_docs(
    df: DataFrame,
    path: str,
    by: str | None = "lang",
    mode: str = "errorifexists",
    rows_per_file: int = 0,
    rebalance: bool = False,
) -> None:
    """Write a table as parquet, partitioned by a copy of ``by`` so that reads can prune.

    The copy is named ``part_<by>`` and holds the value as text behind a colon; the
    column itself stays in the files, so that empty, numeric and missing values
    come back as they were. Filter by the copy with :func:`in_part` to prune.
    The default shuffles nothing: each task writes one file per value it holds.
    ``rebalance`` lets adaptive execution gather each value first, into evenly
    sized files; a value holding a large part of the rows is split over several
    tasks rather than written by one.
    """
    if by:
        df = df.withColumn(PART + by, part_of(F.col(by)))
    if rebalance and by:
        df = df.hint("rebalance", F.col(PART + by))
    writer = df.write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if by:
        writer = writer.partitionBy(PART + by)
    writer.parquet(path)


def part_of(value: Column) -> Column:
    """The value as text behind a colon, which keeps Spark from reading it as a number or as missing."""
    return F.concat(F.lit(":"), F.coalesce(value.cast("string"), F.lit("")))


def in_part(by: str, value: object) -> Column:
    """Condition on a table written with ``by`` that lets the scan skip other partitions."""
    return (F.col(PART + by) == part_of(F.lit(value))) & (F.col(by) == value)
