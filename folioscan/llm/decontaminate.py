"""Benchmark decontamination by spaced seeds.

A spaced seed looks at some words of a window and ignores the others. The seeds of
a benchmark item and of a document are hashed under the same fixed masks, and equal
hashes align the two. Around every hit the aligned words are compared one by one.

A document repeats an item where ``NEEDED`` of ``WINDOW`` aligned words in a row are
equal. The two masks find every such place: however two of thirteen words differ,
one mask fits between them. Of items shorter than the window all words must be
equal, unchanged and in a row; items of fewer than ``LEAST`` words say nothing.

Words are runs of letters and digits in lower case. Null and empty texts and an
empty benchmark give no rows. Repeated rows give one row for each document and
item. A document without an id is compared, and reported without an id. Extra columns of
either table are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.session import staged

WINDOW = 13
NEEDED = 11
LEAST = 5
MASKS = ((0, 1, 3, 5, 6, 7), (0, 1, 2, 5, 7, 8))
#: Hits of one alignment are compared together in blocks of so many places.
BLOCK = 32
#: Most seeds of a benchmark that are sent to every executor (about 40 bytes each).
BROADCAST_SEEDS = 500_000

NOT_A_WORD = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD), "")


def seed(mask: tuple[int, ...], words: str, at: str) -> Column:
    """Hash of the words under a mask that starts at a place."""
    shown = [F.get(F.col(words), F.col(at) + place) for place in mask]
    return F.xxhash64(F.lit(",".join(map(str, mask))), *shown)


def seeds(texts: DataFrame, masks: tuple[tuple[int, ...], ...], *kept: str) -> DataFrame:
    """``at, seed`` of every window of every text, beside the columns ``kept`` and ``words``.

    ``at`` is the place of the window's first word.
    """
    least = min(mask[-1] for mask in masks)
    placed = texts.where(F.size("words") > least).select(
        *kept, "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.lit(least + 1))).alias("at")
    )
    # A window that runs past the end has no seed.
    found = [
        F.when(F.col("at") + mask[-1] < F.size("words"), seed(mask, "words", "at")) for mask in masks
    ]
    return placed.select(*kept, "words", "at", F.explode(F.array(*found)).alias("seed")).where(
        F.col("seed").isNotNull()
    )


def items_of(benchmark: DataFrame) -> DataFrame:
    """``item_id, item, n, need``: distinct items, and how many words in a row must be equal."""
    n = F.size("item")
    return (
        benchmark.select("item_id", words_of(F.col("text")).alias("item"))
        .where(n >= LEAST)
        .distinct()
        .select("item_id", "item", n.alias("n"), F.when(n < WINDOW, n).otherwise(NEEDED).alias("need"))
    )


def masks_of(items: DataFrame) -> tuple[tuple[int, ...], ...]:
    """The spaced masks, and a gapless one for every length of the items below the window."""
    short = items.where(F.col("n") < WINDOW).select("n").distinct().collect()
    return (*MASKS, *(tuple(range(n)) for n in sorted(row["n"] for row in short)))


def item_seeds(items: DataFrame, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """``seed, item_id, place``; short items have only their own gapless seed."""
    texts = items.withColumnRenamed("item", "words")
    parts = []
    for mask in masks:
        long_enough = F.col("n") >= WINDOW if mask in MASKS else F.col("n") == len(mask)
        parts.append(seeds(texts.where(long_enough), (mask,), "item_id"))
    found = reduce(DataFrame.unionAll, parts)
    return found.select("seed", "item_id", F.col("at").alias("place"))


def nearby(words: str, start: Column) -> Column:
    """The document's words beside a block of an alignment, as one text.

    ``start`` is where the block's first word would stand; places before the
    document's first word are left empty, so that both sides stay aligned.
    """
    first = F.greatest(start, F.lit(0))
    length = F.lit(BLOCK + 2 * WINDOW) - (first - start)
    empty = F.repeat(F.lit(" "), first - start)
    return F.concat(empty, F.array_join(F.slice(F.col(words), first + 1, F.greatest(length, F.lit(0))), " "))


def block_of(place: str = "place") -> Column:
    """First item place that a block of hits looks at; it may lie before the item."""
    return (F.floor(F.col(place) / BLOCK) * BLOCK - WINDOW).cast("int")


def repeated_items(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, equal_words, doc_start`` of every item that a document repeats.

    ``equal_words`` is the most equal words in a window, ``doc_start`` the place
    of the document's first word that begins such a window.
    """
    items = items_of(benchmark)
    masks = masks_of(items)
    of_items = item_seeds(items, masks)
    texts = documents.select("doc_id", words_of(F.col("text")).alias("words"))
    shift = (F.col("at") - F.col("place")).alias("shift")
    if of_items.count() <= BROADCAST_SEEDS:
        hits = seeds(texts, masks, "doc_id").join(F.broadcast(of_items), "seed")
        placed = hits.select("doc_id", "item_id", shift, block_of().alias("block"), "words")
        of_items_words = F.broadcast(items)
    else:
        hits = seeds(texts, masks, "doc_id").drop("words").join(of_items, "seed")
        found = hits.select("doc_id", "item_id", shift, block_of().alias("block")).distinct()
        placed = found.withColumnRenamed("doc_id", "_id").join(
            texts, F.col("_id").eqNullSafe(F.col("doc_id"))
        )
        of_items_words = items
    start = F.col("shift") + F.col("block")
    blocks = placed.select("doc_id", "item_id", "shift", "block", nearby("words", start).alias("near"))
    return compared(blocks.distinct().join(of_items_words, "item_id"))


def compared(blocks: DataFrame) -> DataFrame:
    """Compare the aligned words of every block and keep what is equal enough."""
    length = BLOCK + 2 * WINDOW
    there = F.split("near", " ", -1)
    item_at = F.col("block")
    before = F.greatest(-item_at, F.lit(0))
    aligned = F.concat(
        F.array_repeat(F.lit(""), before),
        F.slice("item", F.greatest(item_at, F.lit(0)) + 1, F.lit(length) - before),
    )
    equal = F.zip_with(there, aligned, lambda a, b: ((a == b) & (a != "")).cast("int"))
    counted = F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda i: F.when(
            F.get("equal", i) == 1,
            F.struct(
                F.aggregate(
                    F.slice("equal", i + 1, F.least(F.col("n"), F.lit(WINDOW))),
                    F.lit(0),
                    lambda total, x: total + F.coalesce(x, F.lit(0)),
                ).alias("equal_words"),
                (F.col("shift") + F.col("block") + i).alias("doc_start"),
            ),
        ),
    )
    return (
        blocks.select("doc_id", "item_id", "shift", "block", "n", "need", equal.alias("equal"))
        .select("doc_id", "item_id", "need", F.explode(counted).alias("found"))
        .where(F.col("found.equal_words") >= F.col("need"))
        .groupBy("doc_id", "item_id")
        .agg(
            F.max("found.equal_words").cast("long").alias("equal_words"),
            F.min("found.doc_start").cast("long").alias("doc_start"),
        )
    )


def without_repeated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that repeat no item; a document without an id is kept if no such one does.

    The ids found are written first: Spark then knows their size before it decides
    whether the texts have to move.
    """
    ids = repeated_items(documents, benchmark).select(F.col("doc_id").alias("_id")).distinct()
    found = staged(ids, "repeated")
    return documents.join(found, documents["doc_id"].eqNullSafe(found["_id"]), "left_anti")


#: The same result by comparing every equal word of documents and items.
CHECK_SQL = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
         i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
         dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS spot FROM d),
         iw AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS place
                FROM i WHERE len(w) >= {LEAST}),
         m AS (SELECT doc_id, item_id, n, spot - place AS shift, place, spot FROM dw JOIN iw USING (word)),
         c AS (SELECT doc_id, item_id, n, spot,
                      count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY place
                                     RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS equal_words
               FROM m)
    SELECT doc_id, item_id, max(equal_words) AS equal_words, min(spot) AS doc_start
    FROM c WHERE equal_words >= CASE WHEN n < {WINDOW} THEN n ELSE {NEEDED} END
    GROUP BY doc_id, item_id"""
