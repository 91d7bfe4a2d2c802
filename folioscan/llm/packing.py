"""Best-fit packing after Martello-Toth dominance reduction.

Documents become pieces of at most ``capacity`` tokens. How many pieces there
are of each length is all that packing depends on, and there are at most
``capacity`` lengths, however many documents: the plan is made from these counts.

Reduction: a set of pieces is fixed for good where no other set with its longest
piece can be better. That holds for a piece nothing fits beside, for two pieces
that fill a sequence exactly, and, where no two further pieces fit beside the
longest, for it and the longest that does. What is left is packed best-fit, the
longest first. The plan gives each length blocks of places; every piece finds
its own place from its length and its rank among the pieces of that length.

Null and empty texts are one piece, the closing id 0. Repeated rows and repeated
ids are packed one by one; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import give_back, slices, texts_of
from folioscan.llm.token_counts import Pieces
from folioscan.session import staged

CAPACITY = 2048
CLOSING = b"\0\0\0\0"
#: Rows and bytes encoded together: the more they are, the more of their pieces recur.
TOGETHER = 10_000, 4 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
PACKED = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
)


class Ids(Pieces):
    """Token ids as little-endian bytes."""

    def results(self, places: np.ndarray, edges: np.ndarray) -> list[bytes]:
        ids = self.kept.of(places).tobytes()
        ends = (self.ends(places, edges) * 4).tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=4)
def ids_of(path: str) -> Ids:
    """One encoder for each vocabulary and Python worker."""
    return Ids(path)


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """``piece, start, length, crc`` of a document; only the first piece may be shorter."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)]
    for piece, (a, b) in enumerate(zip(edges, edges[1:])):
        yield piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b])


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document, and their rank by length within their partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        seen: dict[int, int] = {}
        for batch in slices(batches, *TOGETHER):
            columns: list[list] = [[] for _ in range(7)]
            encoded = ids_of(path).all(texts_of(batch))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded):
                for piece, start, length, crc in cut(ids + CLOSING, capacity):
                    place = seen.get(length, 0)
                    seen[length] = place + 1
                    row = (doc_id, piece, start, length, crc, part, place)
                    for column, value in zip(columns, row):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"],
            )
        # The worker goes on to tasks of other stages; they need the memory.
        ids_of(path).kept.clear()
        give_back()

    return documents.select("doc_id", "text").mapInArrow(run, PIECES)


Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def reduce_dominated(counts: np.ndarray, capacity: int) -> Plan:
    """Fix sets that dominate all others with their longest piece; ``counts`` keeps the rest."""
    fixed: Plan = []
    for length in range(capacity, 0, -1):
        while counts[length]:
            room = capacity - length
            counts[length] -= 1
            fitting = np.flatnonzero(counts[: room + 1])
            counts[length] += 1
            if not len(fitting):
                fixed.append((((length, 1),), int(counts[length])))
                counts[length] = 0
                break
            partner = int(fitting[-1])
            least = int(fitting[0])
            counts[length] -= 1
            second = least if counts[least] > 1 else int(fitting[1]) if len(fitting) > 1 else capacity
            counts[length] += 1
            if partner != room and least + second <= room:
                break
            if partner == length:
                n = int(counts[length] // 2)
                fixed.append((((length, 2),), n))
                counts[length] -= 2 * n
            else:
                n = int(min(counts[length], counts[partner]))
                fixed.append((((length, 1), (partner, 1)), n))
                counts[length] -= n
                counts[partner] -= n
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing; equal sequences are treated together."""
    open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {capacity: []}
    rooms = np.zeros(capacity + 1, dtype=bool)
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            fitting = np.flatnonzero(rooms[length:])
            room = int(fitting[0]) + length if len(fitting) else capacity
            fresh = not len(fitting)
            held, n = ((), left) if fresh else open_[room].pop()
            each = min(room // length, left)
            used = min(n, left // each)
            if not fresh:
                if n > used:
                    open_[room].append((held, n - used))
                rooms[room] = bool(open_[room])
            after = room - each * length
            open_.setdefault(after, []).append(((*held, (length, each)), used))
            rooms[after] = after > 0
            left -= used * each
    return [group for groups in open_.values() for group in groups]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Sets of lengths and how many sequences hold each."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    return reduce_dominated(left, capacity) + best_fit(left, capacity)


def blocks(planned: Plan) -> dict[str, np.ndarray]:
    """For each length, in order of rank: the sequences and offsets its pieces go to."""
    rows, given, base = [], {}, 0
    for held, n in planned:
        offset = 0
        for length, each in held:
            rank = given.get(length, 0)
            rows.append((length, rank, each, base, offset))
            given[length] = rank + each * n
            offset += each * length
        base += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    names = ("length", "rank", "each", "base", "offset")
    return {name: table[:, i] for i, name in enumerate(names)}


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence and its offset there."""
    spark = documents.sparkSession
    cut_up = staged(pieces(documents, path, capacity), "pieces")
    by_part = cut_up.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    totals = by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()
    places = spark.sparkContext.broadcast(blocks(plan({r["length"]: r["n"] for r in totals}, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = cut_up.join(earlier, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("place") + F.col("earlier")).alias("rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = places.value
        # Lengths are far below 2**20 and ranks below 2**43, so that both fit one key.
        keys = (known["length"] << 43) + known["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 43) + rank, side="right") - 1
            nth = rank - known["rank"][at]
            each = known["each"][at]
            columns = [batch.column(i) for i in range(5)]
            columns += [pa.array(known["base"][at] + nth // each)]
            columns += [pa.array(known["offset"][at] + nth % each * length)]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    return ranked.mapInArrow(run, PACKED)
