"""Importance resampling towards a target distribution, over batches of concatenated texts.

Documents and target texts are bags of word n-grams, hashed to buckets. A bucket's gain
says how much likelier it is among the targets; a document's weight is the sum of the gains
of its features. Gumbel noise drawn from its id is added, and the highest sums are the
sample: a draw without replacement in proportion to the exponential of the weights.

The texts of a batch are joined with separators, and one pass of a pattern finds all words
of all of them. The places where the documents begin, searched for the places of the words,
give the document of each word; n-grams whose first and last word are of different documents
are masked, and what is left is counted by document or by bucket.

Counts are combined in each task, so a task sends at most one number a bucket, and the driver
gets one row a bucket. The sample is ranked in a distributed sort; a third key splits ids that
many rows share.

Null and empty texts have no features and a weight of 0. Rows without an id have no noise and
no score; they count towards the corpus, but are neither drawn nor among those of which a
share is drawn. Repeated rows and rows with one id are drawn one by one and rank next to each
other. Without documents or targets all counts are 0; an empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import slices, texts_of
from folioscan.session import staged

BUCKETS = 10_000
#: Longest run of words that is a feature.
RUN = 1
SEED = 2024
#: Documents of fewer words are not drawn.
LEAST_WORDS = 20
#: Hundredths of the others that are drawn.
DRAWN = 10

#: Bytes of texts that are joined at a time; a longer text is joined to nothing.
JOINED = 1 << 22
#: Words that Python holds as objects at a time, and of which a worker keeps the hash.
AT_ONCE, KEPT = 1 << 16, 200_000
SEPARATOR = b"\0"
#: Fixed value: words are runs of these bytes of lower-cased UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SCORED = "doc_id long, n_features long, n_words long, weight long"


class Hashes(dict):
    """crc32 of words, worked out once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        found = self[word] = zlib.crc32(word)
        return found


KNOWN = Hashes()


class Batch:
    """The words of texts that are joined with separators."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.joined = SEPARATOR.join(texts).lower()
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=self.n)
        self.begins = np.cumsum(sizes + len(SEPARATOR)) - sizes - len(SEPARATOR)
        starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        ends = [starts[0]]
        words = WORD.finditer(self.joined)
        while some := list(islice(words, AT_ONCE)):
            spans = np.array([word.span() for word in some], dtype=np.int64)
            starts.append(spans[:, 0])
            ends.append(spans[:, 1])
            found = map(KNOWN.__getitem__, (word[0] for word in some))
            hashes.append(np.fromiter(found, dtype=np.uint32, count=len(some)))
        self.starts, self.ends, self.hashes = map(np.concatenate, (starts, ends, hashes))
        self.owner = np.searchsorted(self.begins, self.starts, side="right") - 1

    def features(self, run: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The documents and the buckets of the n-grams of each length up to ``run``."""
        yield self.owner, self.hashes % np.uint32(buckets)
        grams = self.hashes
        for n in range(2, run + 1):
            # One more word each: a checksum goes on from that of the shorter n-gram.
            grams = np.fromiter(
                (
                    zlib.crc32(b" " + self.joined[a:b], int(crc))
                    for crc, a, b in zip(grams[:-1], self.starts[n - 1 :], self.ends[n - 1 :])
                ),
                dtype=np.uint32,
                count=max(len(grams) - 1, 0),
            )
            inside = self.owner[: len(grams)] == self.owner[n - 1 :]
            yield self.owner[: len(grams)][inside], (grams % np.uint32(buckets))[inside]

    def words_of_each(self) -> np.ndarray:
        return np.bincount(self.owner, minlength=self.n)


def joined(batch: pa.RecordBatch) -> Iterator[Batch]:
    """The texts of a batch, in the order of its rows, about ``JOINED`` bytes at a time."""
    block, size = [], 0
    for text in texts_of(batch):
        data = text.encode("utf-8", "surrogatepass")
        if block and size + len(data) > JOINED:
            yield Batch(block)
            block, size = [], 0
        block.append(data)
        size += len(data)
    if block:
        yield Batch(block)


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of all texts fall into each bucket; empty ones have no row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches):
            for block in joined(batch):
                for _, found in block.features(run, buckets):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(count, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gathered(counts: DataFrame, buckets: int) -> np.ndarray:
    """The counts as one array: at most ``buckets`` rows come to the driver."""
    found = np.zeros(buckets)
    for row in counts.collect():
        found[row["bucket"]] = row["n"]
    return found


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed ratio of shares, rounded down."""
    buckets = len(corpus)
    ratio = (target + 1) * (corpus.sum() + buckets) / ((corpus + 1) * (target.sum() + buckets))
    return np.floor(1000 * np.log(ratio))


def weights(documents: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """``doc_id, n_features, n_words, weight`` of every document."""
    sent = documents.sparkSession.sparkContext.broadcast(gain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in slices(batches):
            columns: list[list[np.ndarray]] = [[], [], []]
            for block in joined(batch):
                counted, weighed = np.zeros(block.n, np.int64), np.zeros(block.n, np.int64)
                for owner, found in block.features(run, len(known)):
                    counted += np.bincount(owner, minlength=block.n)
                    # Sums of whole numbers, exact in doubles.
                    weighed += np.bincount(owner, known[found], block.n).astype(np.int64)
                for column, values in zip(columns, (counted, block.words_of_each(), weighed)):
                    column.append(values)
            arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *arrays], ["doc_id", "n_features", "n_words", "weight"]
            )

    return documents.select("doc_id", "text").mapInArrow(score, SCORED)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise drawn from the id, rounded down; null without one."""
    named = F.concat(F.lit(f"{seed}:"), doc_id.cast("string"))
    drawn = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((drawn + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with their place, from 1, in the order of all of them.

    Each partition of a sort by ranges numbers its rows; what the partitions before it
    hold is added. No task has more than its range.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"{rows.schema.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, part int, place long"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        seen = 0
        for batch in batches:
            n = batch.num_rows
            places = pa.array(np.arange(seen + 1, seen + n + 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, np.int32)), places], [*batch.schema.names, "part", "place"]
            )
            seen += n

    numbered = staged(ordered.mapInArrow(number, schema), "numbered")
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("of"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition, so one task may add them up.
    earlier = sizes.select("part", F.coalesce(F.sum("of").over(before), F.lit(0)).alias("earlier"))
    return numbered.join(F.broadcast(earlier), "part").select(
        *rows.columns, (F.col("place") + F.col("earlier")).alias(name)
    )


def resample(
    documents: DataFrame,
    target: DataFrame,
    run: int = RUN,
    buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    drawn: int = DRAWN,
    seed: int = SEED,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; rank is null where it is not drawn.

    Of the documents of at least ``least_words`` words, ``drawn`` hundredths are drawn.
    """
    gain = gains(
        gathered(bucket_counts(documents, run, buckets), buckets),
        gathered(bucket_counts(target, run, buckets), buckets),
    )
    scored = weights(documents, gain, run).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = staged(scored, "scored")
    may = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    n = scored.where(may).count() * drawn // 100
    named = ["doc_id", "n_features", "weight", "score"]
    order = [F.col("score").desc(), F.col("doc_id"), F.col("row")]
    placed = ranked(
        scored.where(may).select(*named, F.monotonically_increasing_id().alias("row")), order, "rank"
    )
    given = placed.select(*named, F.when(F.col("rank") <= n, F.col("rank")).alias("rank"))
    return given.unionAll(scored.where(~may).select(*named, F.lit(None).cast("long").alias("rank")))
