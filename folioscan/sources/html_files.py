"""A Spark data source for folders of documents, one file a document.

    spark.dataSource.register(HtmlFiles)
    spark.read.format("html_files").load(path)
    docs.write.format("html_files").mode("append").save(path)

Against Spark's text reader: files are packed into partitions by their size, with a cost for
opening each, so that neither many small files nor a few large ones decide the number of
tasks; a file of no bytes is a row with an empty text; the id is the path below the folder,
whatever the folder's own name; and documents can be written back as files of that name.

A path without a scheme, or with ``file:``, is a folder that all executors share and is read
with Python's own calls; any other is a URI of a store that Arrow knows.
"""

from __future__ import annotations

import fnmatch
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "doc_id string, html string, n_bytes long"
#: Bytes of a partition, and what opening a file counts as.
PACKED, OPENING = 128 << 20, 1 << 20
#: Bytes of a batch of rows; a larger file is a batch of its own.
BATCH = 8 << 20
ENDING = r"\.html?$"
#: Files are written under a name that begins so and renamed when they are whole.
UNFINISHED = "_writing-"


class Folder:
    """A folder that all executors share."""

    def __init__(self, path: str):
        self.root = re.sub(r"^file:/+", "/", path).rstrip("/")

    def files(self) -> Iterator[tuple[str, int]]:
        """Paths below the folder and their sizes."""
        for folder, _, names in os.walk(self.root):
            for name in names:
                path = os.path.join(folder, name)
                yield os.path.relpath(path, self.root), os.path.getsize(path)

    def read(self, path: str) -> bytes:
        with open(f"{self.root}/{path}", "rb") as file:
            return file.read()

    def write(self, path: str, data: bytes) -> None:
        folder, _, _ = f"{self.root}/{path}".rpartition("/")
        os.makedirs(folder, exist_ok=True)
        unfinished = f"{folder}/{UNFINISHED}{uuid.uuid4().hex}"
        with open(unfinished, "wb") as file:
            file.write(data)
        os.replace(unfinished, f"{self.root}/{path}")


class Store(Folder):
    """A folder of a store that Arrow knows; stores write whole files or none."""

    def __init__(self, path: str):
        # Imported here, as Arrow's file systems start threads, which a forked worker has no use for.
        from pyarrow import fs

        self.system, root = fs.FileSystem.from_uri(path)
        self.root = root.rstrip("/")
        self.all = fs.FileSelector(root, recursive=True)

    def files(self) -> Iterator[tuple[str, int]]:
        for info in self.system.get_file_info(self.all):
            if info.is_file:
                yield info.path[len(self.root) + 1 :], info.size or 0

    def read(self, path: str) -> bytes:
        with self.system.open_input_stream(f"{self.root}/{path}") as file:
            return file.read()

    def write(self, path: str, data: bytes) -> None:
        with self.system.open_output_stream(f"{self.root}/{path}") as file:
            file.write(data)


def store_of(path: str) -> Folder:
    return Store(path) if re.match(r"^(?!file:)[a-z][a-z0-9+.-]*://", path) else Folder(path)


@dataclass
class Pack(InputPartition):
    """Files that one task reads: ids and paths."""

    files: list[tuple[str, str]]


def packed(sizes: list[int], most: int, opening: int) -> Iterator[tuple[int, int]]:
    """Ranges of files that together stay within ``most``; a larger file is alone."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size + opening > most:
            yield begin, i
            begin, held = i, 0
        held += size + opening
    if begin < len(sizes):
        yield begin, len(sizes)


class HtmlReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.glob = options.get("glob", "*.htm*")
        self.most = int(options.get("packed", PACKED))
        self.opening = int(options.get("opening", OPENING))

    def partitions(self) -> list[Pack]:
        files = sorted(
            (path, size)
            for path, size in store_of(self.path).files()
            if fnmatch.fnmatch(path.rpartition("/")[2], self.glob) and not path.rpartition("/")[2].startswith(("_", "."))
        )
        named = [(re.sub(ENDING, "", path), path) for path, _ in files]
        ranges = packed([size for _, size in files], self.most, self.opening)
        return [Pack(named[a:b]) for a, b in ranges]

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        store = store_of(self.path)
        rows: list[tuple[str, str, int]] = []
        held = 0
        for doc_id, path in partition.files if partition else []:
            data = store.read(path)
            if rows and held + len(data) > BATCH:
                yield batch_of(rows)
                rows, held = [], 0
            rows.append((doc_id, data.decode("utf-8", "replace"), len(data)))
            held += len(data)
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64())
    columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "html", "n_bytes"])


class HtmlWriter(DataSourceWriter):
    """Writes each row as a file; a task that runs twice writes the same files again."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.ending = options.get("ending", ".html")

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store = store_of(self.path)
        for row in rows:
            doc_id = str(row["doc_id"])
            if row["doc_id"] is None or doc_id.startswith("/") or ".." in doc_id.split("/"):
                raise ValueError(f"no file can be named {row['doc_id']!r}")
            store.write(doc_id + self.ending, (row["html"] or "").encode("utf-8", "surrogatepass"))
        return WriterCommitMessage()


class HtmlFiles(DataSource):
    """``doc_id, html, n_bytes``; options ``glob``, ``packed``, ``opening`` to read, ``ending`` to write."""

    @classmethod
    def name(cls) -> str:
        return "html_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return HtmlReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files are added to a folder; use mode('append')")
        return HtmlWriter(self.options)


def read_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``doc_id, html, n_bytes`` of every file below a folder; see :class:`HtmlFiles`."""
    spark.dataSource.register(HtmlFiles)
    return spark.read.format("html_files").options(**options).load(path)


def write_files(docs: DataFrame, path: str, **options: str) -> None:
    """Write each row of ``docs(doc_id, html)`` as a file of its own below a folder."""
    docs.sparkSession.dataSource.register(HtmlFiles)
    docs.select("doc_id", "html").write.format("html_files").mode("append").options(**options).save(path)
