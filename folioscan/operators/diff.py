"""Line differences between versions of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions.columns import counts, let


def revision_diff(texts: DataFrame, a: object, b: object) -> DataFrame:
    """``line, side, text`` of the lines in which documents ``a`` and ``b`` differ by position.

    The two ids reach the scan as a filter. An id without a document has no lines.
    """
    doc = F.col("doc_id")
    both = texts.where(doc.isin(a, b)).agg(
        F.max(F.when(doc == a, F.col("text"))).alias("text_a"),
        F.max(F.when(doc == b, F.col("text"))).alias("text_b"),
    )
    return _differing_lines(both, [])


def revision_diffs(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, line, side, text`` for every pair ``a, b``.

    ``side`` is a or b; ``line`` counts from 0. Both texts of a pair meet in one
    row and are compared there, so lines are never shuffled.
    """
    return _differing_lines(_paired(texts, pairs), ["a", "b"])


def _differing_lines(paired: DataFrame, keys: list[str]) -> DataFrame:
    lines = F.arrays_zip(_lines("text_a").alias("a"), _lines("text_b").alias("b"))
    numbered = paired.select(*keys, F.posexplode(lines).alias("line", "at"))
    changed = numbered.where(~F.col("at.a").eqNullSafe(F.col("at.b")))
    sides = F.filter(
        F.array(
            F.struct(F.lit("a").alias("side"), F.col("at.a").alias("text")),
            F.struct(F.lit("b").alias("side"), F.col("at.b").alias("text")),
        ),
        lambda s: s["text"].isNotNull(),
    )
    return changed.select(*keys, "line", F.inline(sides))


def line_changes(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, text, n_a, n_b``: lines a pair does not hold equally often, wherever they stand.

    Both texts are in one row and are counted there; a document that is missing
    has no lines.
    """

    def marked(column: str, side: int) -> Column:
        return F.transform(
            _lines(column), lambda t: F.struct(t.alias("text"), F.lit(side).alias("side"))
        )

    # Counted by line and side; the sides of a line stand next to each other.
    both = counts(F.concat(marked("text_a", 0), marked("text_b", 1)))

    def sides(found: Column) -> Column:
        def change(line: Column, i: Column) -> Column:
            before, after = F.get(found, i - 1), F.get(found, i + 1)
            text, side = line["value"]["text"], line["value"]["side"]
            other = F.when(
                side == 0, F.when((after["value"]["text"] == text), after["n"])
            ).otherwise(F.when((i > 0) & (before["value"]["text"] == text), before["n"]))
            return F.struct(
                text.alias("text"),
                F.when(side == 0, line["n"]).otherwise(F.coalesce(other, F.lit(0))).alias("n_a"),
                F.when(side == 1, line["n"]).otherwise(F.coalesce(other, F.lit(0))).alias("n_b"),
                # A line of both sides is told once, at its first side.
                ((side == 0) | other.isNull()).alias("first"),
            )

        changes = F.filter(F.transform(found, change), lambda c: c["first"] & (c["n_a"] != c["n_b"]))
        return F.transform(changes, lambda c: F.struct(c["text"], c["n_a"], c["n_b"]))

    return _paired(texts, pairs).select("a", "b", F.inline(let(both, sides)))


def aligned_diffs(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b, side, line, text``: lines of ``a`` that are gone and lines of ``b`` that are new.

    The lines in between are the same on both sides and in the same order, so a line
    that was put in is one row and moves nothing after it; a line that was changed is
    one row of each side. ``line`` counts from 0 on its own side.

    Both texts are in one row and are aligned there:

    1. Equal lines at the beginning and at the end are set aside.
    2. Lines that each side holds once are matched. The longest run of matches that
       rises on both sides holds the anchors.
    3. Between two anchors lines are matched from the front while they are equal and
       then from the back; what is left differs.
    """
    return _paired(texts, pairs).select("a", "b", F.inline(_aligned(_lines("text_a"), _lines("text_b"))))


def aligned_diff(texts: DataFrame, a: object, b: object) -> DataFrame:
    """``side, line, text`` of two documents; see :func:`aligned_diffs`."""
    pair = texts.sparkSession.range(1).select(F.lit(a).alias("a"), F.lit(b).alias("b"))
    return aligned_diffs(texts.where(F.col("doc_id").isin(a, b)), pair).drop("a", "b")


def _common_start(one: Column, other: Column) -> Column:
    """How many elements from the front on are equal."""
    n = F.least(F.size(one), F.size(other))
    same = F.zip_with(F.slice(one, F.lit(1), n), F.slice(other, F.lit(1), n), lambda x, y: x == y)
    return let(
        F.array_position(same, False).cast("int"), lambda at: F.when(at > 0, at - 1).otherwise(F.size(same))
    )


def _trimmed(one: Column, other: Column) -> Column:
    """``start, a, b``: both lists without their equal beginning and, after that, their equal end."""

    def without_end(start: Column) -> Column:
        a = F.slice(one, start + 1, F.size(one))
        b = F.slice(other, start + 1, F.size(other))
        rests = F.struct(start.alias("start"), a.alias("a"), b.alias("b"))

        def cut(rest: Column) -> Column:
            end = _common_start(F.reverse(rest["a"]), F.reverse(rest["b"]))
            return let(
                end,
                lambda n: F.struct(
                    rest["start"].alias("start"),
                    F.slice(rest["a"], F.lit(1), F.size(rest["a"]) - n).alias("a"),
                    F.slice(rest["b"], F.lit(1), F.size(rest["b"]) - n).alias("b"),
                ),
            )

        return let(rests, cut)

    return let(_common_start(one, other), without_end)


def _unique_matches(one: Column, other: Column) -> Column:
    """``i, j``: places of the elements that each list holds once, in the order of the first."""

    def marked(values: Column, side: int) -> Column:
        return F.transform(
            values, lambda v, i: F.struct(v.alias("value"), F.lit(side).alias("side"), i.alias("place"))
        )

    def pairs(both: Column) -> Column:
        def match(x: Column, i: Column) -> Column:
            before, after, third = F.get(both, i - 1), F.get(both, i + 1), F.get(both, i + 2)
            alone = ~F.coalesce((i > 0) & (before["value"] == x["value"]), F.lit(False))
            twice = (after["side"] == 1) & (after["value"] == x["value"])
            once = ~F.coalesce(third["value"] == x["value"], F.lit(False))
            fits = (x["side"] == 0) & alone & F.coalesce(twice, F.lit(False)) & once
            return F.when(fits, F.struct(x["place"].alias("i"), after["place"].alias("j")))

        return F.sort_array(F.filter(F.transform(both, match), lambda m: m.isNotNull()))

    return let(F.sort_array(F.concat(marked(one, 0), marked(other, 1))), pairs)


def _longest_rise(matches: Column) -> Column:
    """The matches of a longest run in which the second place rises, by patience sorting.

    ``ends`` holds the least last place of a rise of each length; a match goes where the
    first of them that is not smaller stands, found by halving.
    """
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("ends"), none.alias("lengths"))
    halvings = F.sequence(F.lit(1), F.ceil(F.log2(F.size(matches) + 2)).cast("int") + 1)

    def place(ends: Column, j: Column) -> Column:
        bounds = F.struct(F.lit(0).alias("low"), F.size(ends).alias("high"))

        def halve(at: Column, _: Column) -> Column:
            middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
            done, smaller = at["low"] >= at["high"], F.get(ends, middle) < j
            return F.struct(
                F.when(done | ~smaller, at["low"]).otherwise(middle + 1).alias("low"),
                F.when(done | smaller, at["high"]).otherwise(middle).alias("high"),
            )

        return F.aggregate(halvings, bounds, halve, lambda at: at["low"])

    def step(state: Column, match: Column) -> Column:
        def put(at: Column) -> Column:
            ends = F.concat(
                F.slice(state["ends"], F.lit(1), at),
                F.array(match["j"]),
                F.slice(state["ends"], at + 2, F.size(state["ends"])),
            )
            return F.struct(ends.alias("ends"), F.concat(state["lengths"], F.array(at + 1)).alias("lengths"))

        return let(place(state["ends"], match["j"]), put)

    def picked(lengths: Column) -> Column:
        last = F.struct(
            F.coalesce(F.array_max(lengths), F.lit(0)).alias("wanted"),
            F.lit(2**31 - 1).alias("below"),
            F.array().cast("array<struct<i:int,j:int>>").alias("found"),
        )
        backwards = F.reverse(F.arrays_zip(matches.alias("match"), lengths.alias("length")))

        def take(state: Column, x: Column) -> Column:
            fits = (x["length"] == state["wanted"]) & (x["match"]["j"] < state["below"])
            return F.when(
                fits,
                F.struct(
                    (state["wanted"] - 1).alias("wanted"),
                    x["match"]["j"].alias("below"),
                    F.concat(state["found"], F.array(x["match"])).alias("found"),
                ),
            ).otherwise(state)

        return F.aggregate(backwards, last, take, lambda state: F.reverse(state["found"]))

    return let(F.aggregate(matches, start, step, lambda state: state["lengths"]), picked)


def _aligned(one: Column, other: Column) -> Column:
    """``side, line, text`` of the elements that are not matched."""

    def differing(rest: Column) -> Column:
        begin = F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"))
        end = F.struct(F.size(rest["a"]).alias("i"), F.size(rest["b"]).alias("j"))

        def of_anchors(anchors: Column) -> Column:
            gaps = F.zip_with(
                F.concat(F.array(begin), anchors), F.concat(anchors, F.array(end)), lambda x, y: gap(rest, x, y)
            )
            return F.flatten(gaps)

        return let(_unique_matches(rest["a"], rest["b"]), lambda m: let(_longest_rise(m), of_anchors))

    def gap(rest: Column, x: Column, y: Column) -> Column:
        a = F.slice(rest["a"], x["i"] + 2, y["i"] - x["i"] - 1)
        b = F.slice(rest["b"], x["j"] + 2, y["j"] - x["j"] - 1)

        def lines(values: Column, side: str, first: Column) -> Column:
            return F.transform(
                values,
                lambda v, i: F.struct(F.lit(side).alias("side"), (first + i).alias("line"), v.alias("text")),
            )

        def listed(left: Column) -> Column:
            before = rest["start"] + left["start"] + 1
            return F.concat(lines(left["a"], "a", before + x["i"]), lines(left["b"], "b", before + x["j"]))

        return let(_trimmed(a, b), listed)

    return let(_trimmed(one, other), differing)


def _lines(column: str) -> Column:
    """The lines of a text; none where the document is missing."""
    return F.coalesce(F.split(column, "\n"), F.array().cast("array<string>"))


def _paired(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both texts beside their ids, NULL for an id without a document.

    Texts have one row per id; an ``a`` that many pairs share is split by
    adaptive execution.
    """
    of_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    of_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(of_b, "b", "left").join(of_a, "a", "left")
