"""Column expressions built from Spark's own functions; no Python per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscan.functions import patterns as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is worked out once however often it is used."""
    return F.transform(F.array(value), body).getItem(0)


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at either end."""
    return F.trim(F.regexp_replace(text, P.SPACES, " "))


def unquote(value: Column) -> Column:
    """An attribute value as matched by ``VALUE``, without its quotes; NULL where empty."""
    return let(
        value,
        lambda v: F.when(v == "", F.lit(None))
        .when(
            v.startswith('"') | v.startswith("'"),
            F.substring(v, F.lit(2), F.length(v) - 2),
        )
        .otherwise(v),
    )


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag; NULL where the tag does not have it."""
    return unquote(F.regexp_extract(tag, P.attribute(name), 1))


def all_matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def markup(html: Column) -> Column:
    """The document without comments and without what scripts and styles hold."""
    return F.regexp_replace(html, P.NOT_MARKUP, "$1$2$3$4")


def live(html: Column) -> Column:
    """The document without comments and without what scripts hold; styles stay."""
    return F.regexp_replace(html, P.NOT_LIVE, "$1$2")


def running(steps: Column, block: int = 256) -> Column:
    """``total, low`` at each place of an array of whole numbers: the sum so far and its least value, 0 at most.

    An array that grows by one place a step is copied at every step, so it is done in
    blocks: each of them from 0, then the blocks' ends, then both put together.
    """

    def scan(values: Column, step: Callable[[Column, Column], Column]) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("low"))
        begin = F.array(zero)
        grown = F.aggregate(values, begin, lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
        return F.slice(grown, 2, F.size(values))

    def add(state: Column, x: Column) -> Column:
        total = state["total"] + x
        return F.struct(total.alias("total"), F.least(state["low"], total).alias("low"))

    def follow(state: Column, other: Column) -> Column:
        low = F.least(state["low"], state["total"] + other["low"])
        return F.struct((state["total"] + other["total"]).alias("total"), low.alias("low"))

    empty = F.array().cast("array<int>")
    starts = F.when(F.size(steps) > 0, F.sequence(F.lit(1), F.size(steps), F.lit(block))).otherwise(empty)
    blocks = F.transform(starts, lambda at: scan(F.slice(steps, at, block), add))

    def joined(parts: Column) -> Column:
        ends = scan(F.transform(parts, lambda part: F.element_at(part, -1)), follow)
        return let(
            ends,
            lambda known: F.flatten(
                F.transform(
                    parts,
                    lambda part, i: F.when(i == 0, part).otherwise(
                        F.transform(part, lambda state: follow(F.get(known, i - 1), state))
                    ),
                )
            ),
        )

    return let(blocks, joined)


def visible_text(html: Column) -> Column:
    """Prose of a document; entities stay as written."""
    return squeeze(F.regexp_replace(html, P.NOT_SHOWN, " "))


def words(text: Column) -> Column:
    """Words between white space; the empty text has none."""
    return F.array_remove(F.split(text, P.SPACES), "")


def count_words(squeezed: Column) -> Column:
    """Words of a text that :func:`squeeze` has been through: its spaces and one."""
    spaces = F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit("")))
    return F.when(squeezed == "", 0).otherwise(spaces + 1)


def decimal_amount(text: Column) -> Column:
    """``1.250,50`` as a decimal; NULL beyond 8 digits before the comma."""
    plain = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return plain.try_cast("decimal(10,2)")


def counts(values: Column) -> Column:
    """``value, n`` of the distinct values of an array, in order; the array is sorted once."""

    def of_sorted(ordered: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ordered))
        # Where a value begins, and the end of the array.
        begins = F.filter(
            places,
            lambda i: (i == 0) | (i == F.size(ordered)) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )
        return let(
            begins,
            lambda at: F.transform(
                F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))),
                lambda begin, i: F.struct(
                    F.get(ordered, begin).alias("value"), (F.get(at, i + 1) - begin).cast("long").alias("n")
                ),
            ),
        )

    return let(F.array_sort(values), of_sorted)


def most_frequent(values: Column, k: int) -> Column:
    """The k most frequent values of an array with their counts; ties go to the smaller value."""
    ranked = F.array_sort(
        F.transform(counts(values), lambda c: F.struct((-c["n"]).alias("less"), c["value"].alias("value")))
    )
    return F.transform(
        F.slice(ranked, 1, k), lambda c: F.struct(c["value"].alias("value"), (-c["less"]).alias("n"))
    )


def occurrences(values: Column) -> Column:
    """Per distinct value of an array: how often it occurs (n) and one mark (d).

    Exploding this and summing ``n`` and ``d`` gives occurrences and documents
    in one aggregation, where a distinct count would need a second shuffle.
    """

    def mark(n: int, d: int) -> Callable[[Column], Column]:
        return lambda v: F.struct(v.alias("value"), F.lit(n).alias("n"), F.lit(d).alias("d"))

    return let(
        values,
        lambda vs: F.concat(
            F.transform(vs, mark(1, 0)), F.transform(F.array_distinct(vs), mark(0, 1))
        ),
    )


def word_hashes(found: Column) -> Column:
    """A 64-bit hash of each of the words."""
    return F.transform(found, lambda w: F.xxhash64(w))


def hashed_shingles(hashes: Column, k: int) -> Column:
    """Distinct shingles of k words, given by their hashes; fewer words give an empty array."""
    starts = F.when(F.size(hashes) >= k, F.sequence(F.lit(0), F.size(hashes) - k)).otherwise(
        F.array().cast("array<int>")
    )
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(k)))))


def shingles(text: Column, k: int) -> Column:
    """Distinct k-word shingles of lower-cased text, each as a 64-bit hash.

    Words are hashed first and shingles made of their hashes, which spares
    building a string per shingle. Texts of fewer than k words give an empty
    array.
    """
    return let(word_hashes(words(F.lower(text))), lambda h: hashed_shingles(h, k))
