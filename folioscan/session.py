"""Session for tests and benchmarks, and the shared folder for staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None
_scopes: list[list[str]] = []


def local_session(cpus: str = "8", memory: str = "12g") -> SparkSession:
    """A local session; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("folioscan")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder. A cluster must
    name one: a folder on one machine would be lost with it.
    """
    global _local_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="folioscan-")
    return _local_folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under the id of the application.

    Results are read from staged tables until they are consumed, so nothing is
    deleted here: see :func:`temporary_tables`.
    """
    path = f"{shared_folder(spark)}/folioscan-{spark.conf.get('spark.app.id')}/{name}-{uuid.uuid4().hex}"
    for paths in _scopes:
        paths.append(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete at the end what is staged inside; consume or write results before that.

        with temporary_tables(spark):
            near_duplicates(texts).write.parquet(path)
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for path in paths:
            place = hadoop(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation,
    and later uses read only the columns they need.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
