"""Hard negatives by search in an inverted multi-index.

Vectors are cut in two halves, each with a codebook of its own. A pair of codewords is a
cell, so that two short codebooks make many cells. The score of a row is an inner product;
in a cell it is at most the sum, over both halves, of the query's product with the codeword
and its length times the radius of the codeword, which is the largest distance of any row.

For a query, a heap visits the cells in the order of these sums (the multi-sequence
algorithm of Babenko and Lempitsky 2012). What is looked for are the best rows inside
*windows* of scores: all scores for the positives, for the negatives of a positive those from
``share`` hundredths of its score up to it. A first visit takes the best cells up to ``PROBE``
rows. It gives every window a score that its results reach; the second visit goes on until no
cell left can reach the score of any window, which certifies the windows. Cells whose rows all
lie above the windows are passed over. So the result is exact, whatever the codebooks.

Spark does the work by shards: whole cells of about ``SHARD`` rows together, and a cell with
more is dealt to several by a hash of the id. Every query goes to the shards of the cells it
visits, and a task scores a block of queries against one shard at a time, so nothing is
broadcast but codebooks and counts of cells, at most ``CODES`` squared numbers.

Rows without an id, a label or a vector, or with a null or non-finite component, take no part.
Rows equal in id, label and vector count once; of rows that share an anchor's id only the least
by label and vector is an anchor, and none is its positive or negative. Shorter vectors are
filled with zeros. Components are whole numbers of 32 bits, those beyond are set to the ends;
scores are exact while they stay below 2**53. An empty table gives an empty result, and so do
anchors without positives; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.session import staged

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
#: Hundredths of the positive's score that a negative reaches.
SHARE = 80

#: Codewords of each half, and the rows that they are fitted on.
CODES, SAMPLE, FITS = 32, 20_000, 10
#: Rows of a shard, about; rows that a query's first visit takes.
SHARD, PROBE = 8_192, 2_048
#: Queries that are scored against a shard at a time.
BLOCK = 128
LOWEST, HIGHEST = -(1 << 62), 1 << 62

ROWS = "vec_id long, label int, vector array<int>"
PLACED = f"{ROWS}, cell int, first double, second double"
VISITS = "shard int, kind int, id long, label int, vector array<int>, cells array<int>, lows array<long>, highs array<long>"
HITS = "anchor_id long, slot int, id long, score long"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists as rows of ``dim`` numbers; shorter lists are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    found = np.zeros((len(sizes), dim))
    if len(flat) == found.size and (sizes == dim).all():
        return flat.reshape(found.shape)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    found[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - starts] = flat
    return found


def codebook(rows: np.ndarray, codes: int, fits: int = FITS) -> np.ndarray:
    """At most ``codes`` means of the rows, by Lloyd's algorithm from evenly spaced distinct rows."""
    distinct = np.unique(rows, axis=0)
    if len(distinct) <= codes:
        return distinct
    draw = np.random.default_rng(0).choice(len(distinct), codes, replace=False)
    means = distinct[np.sort(draw)]
    for _ in range(fits):
        nearest = nearest_code(rows, means)[0]
        sizes = np.bincount(nearest, minlength=len(means))
        sums = np.zeros_like(means)
        np.add.at(sums, nearest, rows)
        means = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], means)
    return means


def nearest_code(rows: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest mean of each row and the distance to it."""
    nearest = np.argmin((means**2).sum(1) - 2 * rows @ means.T, axis=1)
    return nearest, np.sqrt(((rows - means[nearest]) ** 2).sum(1))


class Cells:
    """Codebooks, radii, and where the rows of each cell are."""

    def __init__(self, books: tuple[np.ndarray, np.ndarray], rows: list):
        self.books = books
        self.half = books[0].shape[1]
        n = tuple(map(len, books))
        self.radii = tuple(np.full(k, -np.inf) for k in n)
        self.sizes = np.zeros(n[0] * n[1], dtype=np.int64)
        for row in rows:
            cell = row["cell"]
            self.sizes[cell] = row["of"]
            for radii, code, far in zip(self.radii, divmod(cell, n[1]), (row["first"], row["second"])):
                radii[code] = max(radii[code], far)
        self.first = np.zeros_like(self.sizes)
        self.blocks = -(-self.sizes // SHARD)
        shard, held = 0, 0
        for cell, size in enumerate(self.sizes):
            if held and held + size > SHARD:
                shard, held = shard + 1, 0
            self.first[cell] = shard
            if self.blocks[cell] > 1:
                shard, held = shard + int(self.blocks[cell]), 0
            else:
                held += size
        self.shards = shard + 1

    def reach(self, queries: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each query and codeword: the most that a half adds to a score, and the middle."""
        found = []
        for part, means, radii in zip((queries[:, : self.half], queries[:, self.half :]), self.books, self.radii):
            middle = part @ means.T
            spread = np.sqrt((part**2).sum(1))[:, None] * np.maximum(radii, 0)
            # A little more, for what is lost in rounding; codewords without rows reach nothing.
            spread += 1e-9 * (np.abs(middle) + spread) + 1e-6
            found += [np.where(radii >= 0, middle + spread, -np.inf), middle - spread]
        return tuple(found)

    def in_order(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int]]:
        """Cells with rows by the sum of both halves' reach, the highest first.

        A heap holds the border of what has been visited: a cell is added when the ones
        before it in both sequences are gone.
        """
        one, two = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        a, b = (-first[one]).tolist(), (-second[two]).tolist()
        one, two = one.tolist(), two.tolist()
        n_two = len(two)
        #: How far each row of the grid has been visited.
        done = [0] * (len(one) + 1)
        heap = [(a[0] + b[0], 0, 0)]
        while heap:
            cost, i, j = heappop(heap)
            if cost == np.inf:
                return
            done[i] = j + 1
            if i + 1 < len(one) and done[i + 1] == j and (j == 0 or done[i + 1] >= j):
                heappush(heap, (a[i + 1] + b[j], i + 1, j))
            if j + 1 < n_two and (i == 0 or done[i - 1] > j + 1):
                heappush(heap, (a[i] + b[j + 1], i, j + 1))
            cell = one[i] * n_two + two[j]
            if self.sizes[cell]:
                yield -cost, cell

    def shards_of(self, cells: list[int]) -> dict[int, list[int]]:
        """The cells to visit in each shard."""
        found: dict[int, list[int]] = {}
        for cell in cells:
            for block in range(int(self.blocks[cell])):
                found.setdefault(int(self.first[cell]) + block, []).append(cell)
        return found


def taking_part(embeddings: DataFrame) -> DataFrame:
    """``vec_id, label, vector`` of the rows that take part, in whole numbers."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.greatest(
        F.least(F.floor(x.cast("double") * SCALE), F.lit(2**31 - 1)), F.lit(-(2**31))
    ).cast("int")
    given = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return embeddings.where(given & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("int").alias("label"),
        F.transform("embedding", whole).alias("vector"),
    )


def fitted(rows: DataFrame, n: int, dim: int, codes: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks of both halves, from at most ``sample`` rows."""
    drawn = rows if n <= sample else rows.sample(min(1.0, 1.2 * sample / n), seed=1)
    found = drawn.select("vector").limit(sample).toArrow()
    vectors = matrix(found.column("vector"), dim)
    if not len(vectors):
        vectors = np.zeros((1, dim))
    half = dim // 2
    return codebook(vectors[:, :half], codes), codebook(vectors[:, half:], codes)


def placed(rows: DataFrame, books: tuple[np.ndarray, np.ndarray], dim: int) -> DataFrame:
    """Every row with its cell and its distance to both codewords; equal rows of a batch once."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = sent.value
        half = first.shape[1]
        for batch in batches:
            vectors = matrix(batch.column("vector"), dim)
            ids = batch.column("vec_id").to_numpy()
            if len(np.unique(ids)) < len(ids):
                labels = batch.column("label").to_numpy()
                keys = np.column_stack([ids.astype(np.float64), labels, vectors])
                kept = np.sort(np.unique(keys, axis=0, return_index=True)[1])
                batch, vectors = batch.take(pa.array(kept)), vectors[kept]
            one, far = nearest_code(vectors[:, :half], first)
            two, off = nearest_code(vectors[:, half:], second)
            cell = (one * len(second) + two).astype(np.int32)
            arrays = [*batch.columns, pa.array(cell), pa.array(far), pa.array(off)]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "cell", "first", "second"])

    return rows.mapInArrow(run, PLACED)


class Index:
    """The rows of a table by cell and shard."""

    def __init__(self, rows: DataFrame, codes: int = CODES, sample: int = SAMPLE):
        spark = rows.sparkSession
        n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
        self.dim = dim or 0
        books = fitted(rows, n, self.dim, codes, sample)
        found = staged(placed(rows, books, self.dim), "placed")
        sizes = found.groupBy("cell").agg(
            F.count(F.lit(1)).alias("of"), F.max("first").alias("first"), F.max("second").alias("second")
        )
        # At most ``codes`` squared rows.
        self.cells = Cells(books, sizes.collect())
        self.sent = spark.sparkContext.broadcast(self.cells)
        of_cell = spark.createDataFrame(
            [(i, int(a), int(b)) for i, (a, b) in enumerate(zip(self.cells.first, self.cells.blocks)) if b],
            "cell int, begin int, blocks int",
        )
        shard = F.col("begin") + F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")
        self.rows = found.join(F.broadcast(of_cell), "cell").select(
            shard.alias("shard"),
            F.lit(0).alias("kind"),
            F.col("vec_id").alias("id"),
            "label",
            "vector",
            F.array("cell").alias("cells"),
            F.lit(None).cast("array<long>").alias("lows"),
            F.lit(None).cast("array<long>").alias("highs"),
        )

    def visits(self, queries: DataFrame, probe: bool) -> DataFrame:
        """A row for every shard that a query visits: the cells of the first visit, or the others.

        ``queries`` are ``anchor_id, label, vector, lows, highs``, windows as arrays.
        """
        sent, dim = self.sent, self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = sent.value
            for whole in batches:
                for begin in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(begin, BLOCK)
                    most_one, least_one, most_two, least_two = cells.reach(matrix(batch.column("vector"), dim))
                    lows, highs = (batch.column(c).to_pylist() for c in ("lows", "highs"))
                    wanted: list[tuple[int, int, list[int]]] = []
                    for q, (low, high) in enumerate(zip(lows, highs)):
                        least, highest = min(low), max(high)
                        taken, chosen = 0, []
                        for reach, cell in cells.in_order(most_one[q], most_two[q]):
                            if reach < least:
                                break
                            one, two = divmod(cell, len(cells.books[1]))
                            if least_one[q, one] + least_two[q, two] > highest:
                                continue
                            if (taken < PROBE) == probe:
                                chosen.append(cell)
                            taken += int(cells.sizes[cell])
                            if probe and taken >= PROBE:
                                break
                        wanted += [(q, shard, some) for shard, some in cells.shards_of(chosen).items()]
                    at = pa.array([q for q, _, _ in wanted], pa.int64())
                    arrays = [
                        pa.array([shard for _, shard, _ in wanted], pa.int32()),
                        pa.array(np.ones(len(wanted), np.int32)),
                        *(batch.column(c).take(at) for c in ("anchor_id", "label", "vector")),
                        pa.array([some for _, _, some in wanted], pa.list_(pa.int32())),
                        *(batch.column(c).take(at) for c in ("lows", "highs")),
                    ]
                    names = ["shard", "kind", "id", "label", "vector", "cells", "lows", "highs"]
                    yield pa.RecordBatch.from_arrays(arrays, names)

        return queries.select("anchor_id", "label", "vector", "lows", "highs").mapInArrow(run, VISITS)

    def hits(self, visits: DataFrame, same: bool, k: int) -> DataFrame:
        """``anchor_id, slot, id, score``: the best ``k`` rows in each window (slot), shard by shard.

        A task reads a shard's rows before the queries that visit it, and holds one shard
        and one block of queries at a time.
        """
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard = Shard(dim)
            for whole in batches:
                for batch in runs_of(whole):
                    number, kind = batch.column("shard")[0].as_py(), batch.column("kind")[0].as_py()
                    if number != shard.number:
                        shard = Shard(dim, number)
                    if kind == 0:
                        shard.add(batch)
                    else:
                        for begin in range(0, batch.num_rows, BLOCK):
                            yield shard.best(batch.slice(begin, BLOCK), same, k)

        both = self.rows.unionAll(visits).repartition(self.cells.shards, "shard")
        return both.sortWithinPartitions("shard", "kind", "id").mapInArrow(run, HITS)

    def search(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """``anchor_id, slot, rank, id, score``: the best ``k`` rows in every window of every query.

        Rows have the query's label, or another one if ``same`` is false.
        """
        queries = staged(queries, "queries")
        early = staged(self.hits(self.visits(queries, True), same, k), "hits")
        reached = (
            best_of(early, k)
            .groupBy("anchor_id", "slot")
            .agg(F.count(F.lit(1)).alias("of"), F.min("score").alias("score"))
            .where(F.col("of") >= k)
            .groupBy("anchor_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("reached"))
        )
        raised = lambda low, i: F.greatest(low, F.coalesce(F.element_at("reached", i + 1), low))
        certain = queries.join(reached, "anchor_id", "left").select(
            "anchor_id", "label", "vector", F.transform("lows", raised).alias("lows"), "highs"
        )
        late = self.hits(self.visits(certain, False), same, k)
        return staged(best_of(early.unionAll(late), k), "best")


def runs_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of one shard and one kind of rows."""
    shard, kind = (batch.column(c).to_numpy() for c in ("shard", "kind"))
    cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


class Shard:
    """The rows of some cells, in the order of their ids, and their scores for queries."""

    def __init__(self, dim: int, number: int = -1):
        self.dim, self.number = dim, number
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.built = False

    def add(self, batch: pa.RecordBatch) -> None:
        columns = (batch.column(c).to_numpy() for c in ("id", "label"))
        self.parts.append((*columns, batch.column("cells").flatten().to_numpy(), matrix(batch.column("vector"), self.dim)))

    def build(self) -> None:
        self.ids, self.labels, self.cells, self.vectors = map(np.concatenate, zip(*self.parts))
        self.parts, self.built = [], True
        if len(np.unique(self.ids)) < len(self.ids):
            keys = np.column_stack([np.unique(self.ids, return_inverse=True)[1], self.labels, self.vectors])
            kept = np.sort(np.unique(keys, axis=0, return_index=True)[1])
            self.ids, self.labels, self.cells, self.vectors = (
                x[kept] for x in (self.ids, self.labels, self.cells, self.vectors)
            )
        self.places = {int(c): np.flatnonzero(self.cells == c) for c in np.unique(self.cells)}

    def scores(self, queries: np.ndarray, visited: list[list[int]]) -> np.ndarray:
        """Scores of the rows in visited cells; all others are below any window."""
        found = np.full((len(queries), len(self.ids)), -np.inf)
        visitors: dict[int, list[int]] = {}
        for q, cells in enumerate(visited):
            for cell in cells:
                visitors.setdefault(cell, []).append(q)
        for cell, some in visitors.items():
            # A shard of a divided cell may have got none of its rows.
            at = self.places.get(cell)
            if at is not None:
                found[np.ix_(some, at)] = queries[some] @ self.vectors[at].T
        return found

    def best(self, batch: pa.RecordBatch, same: bool, k: int) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], []]
        if self.parts and not self.built:
            self.build()
        if self.built:
            scores = self.scores(matrix(batch.column("vector"), self.dim), batch.column("cells").to_pylist())
            rows = zip(*(batch.column(c).to_pylist() for c in ("id", "label", "lows", "highs")))
            for row, (anchor, label, lows, highs) in zip(scores, rows):
                fits = (self.labels == label) if same else (self.labels != label)
                at = np.flatnonzero(fits & (row >= min(lows)) & (row <= max(highs)) & (self.ids != anchor))
                # In the order of score and, as the rows stand, of id.
                at = at[np.argsort(-row[at], kind="stable")]
                found = row[at]
                for slot, (low, high) in enumerate(zip(lows, highs), 1):
                    begin = int(np.searchsorted(-found, -high))
                    end = min(begin + k, int(np.searchsorted(-found, -low, side="right")))
                    columns[0] += [anchor] * (end - begin)
                    columns[1] += [slot] * (end - begin)
                    columns[2] += self.ids[at[begin:end]].tolist()
                    columns[3] += found[begin:end].astype(np.int64).tolist()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, kinds)], ["anchor_id", "slot", "id", "score"]
        )


def best_of(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` hits of each window with their rank; ties by smaller id."""
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    embeddings: DataFrame,
    is_anchor: Column | Callable[[], Column],
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    share: int = SHARE,
    codes: int = CODES,
    sample: int = SAMPLE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    For every anchor and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels whose score is at least ``share`` hundredths of the
    positive's and at most that.
    """
    rows = taking_part(embeddings)
    index = Index(rows, codes, sample)
    one_each = Window.partitionBy("vec_id").orderBy("label", "vector")
    anchors = (
        rows.where(is_anchor() if callable(is_anchor) else is_anchor)
        .withColumn("nth", F.row_number().over(one_each))
        .where("nth = 1")
        .select(F.col("vec_id").alias("anchor_id"), "label", "vector")
    )
    everything = anchors.withColumns({"lows": F.array(F.lit(LOWEST)), "highs": F.array(F.lit(HIGHEST))})
    near = index.search(everything, True, positives).select(
        "anchor_id", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    # Slots are ranks, without gaps; a window that holds no score keeps its slot.
    least = lambda x: F.ceil(x["positive_score"] * share / 100)
    windows = near.groupBy("anchor_id").agg(
        F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("found")
    )
    asked = anchors.join(windows, "anchor_id").select(
        "anchor_id",
        "label",
        "vector",
        F.transform("found", least).alias("lows"),
        F.transform("found", lambda x: x["positive_score"]).alias("highs"),
    )
    hard = index.search(asked, False, negatives)
    return hard.join(near, ["anchor_id", "slot"]).select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def relabelled(embeddings: DataFrame) -> DataFrame:
    """The table of the query: every seventh id has the next label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", "embedding", moved.alias("label"))


#: The same by comparing every anchor with all rows.
CHECK_SQL = """
WITH taking_part AS (
    SELECT vec_id,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
           list_inner_product(a.vector, r.vector)::BIGINT AS score
    FROM taking_part a JOIN taking_part r ON a.vec_id <> r.vec_id
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score
    FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), hard AS (
    SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
           row_number() OVER (
               PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id
           )::INTEGER AS rank
    FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
    WHERE 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 5
"""
