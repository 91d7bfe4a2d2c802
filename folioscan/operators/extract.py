"""From ``docs(doc_id, html)`` to one row per document or per occurrence.

All of this is row-local: no operator in this module shuffles, but for
:func:`stats_by_language`. ``html`` is read once and dropped straight away.
``pos`` counts from 0 in document order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import patterns as P
from folioscan.functions.columns import (
    all_matches,
    attribute,
    count_words,
    counts,
    decimal_amount,
    let,
    markup,
    running,
    squeeze,
    unquote,
    visible_text as visible_text_of,
)


def title_of(markup: Column) -> Column:
    """The title of a document whose comments and scripts are gone."""
    return squeeze(F.regexp_extract(markup, P.TITLE, 1))


def lang_of(markup: Column) -> Column:
    """The language of a document whose comments and scripts are gone."""
    return F.coalesce(unquote(F.regexp_extract(markup, P.LANG, 1)), F.lit(""))


def with_markup(docs: DataFrame, *kept: str) -> DataFrame:
    """``docs`` with its ``markup``, worked out once for all that is read from it; ``html`` only if kept."""
    return docs.select("doc_id", *kept, markup(F.col("html")).alias("markup"))


def subject_of(html: Column) -> Column:
    """The subject noted in the first comment."""
    header = F.regexp_extract(html, P.FIRST_COMMENT, 1)
    return F.trim(F.regexp_extract(header, P.COMMENT_SUBJECT, 1))


def doc_metadata(docs: DataFrame) -> DataFrame:
    """``doc_id, title, lang``; empty where the document has none."""
    plain = F.col("markup")
    return with_markup(docs).select("doc_id", title_of(plain).alias("title"), lang_of(plain).alias("lang"))


def elements_of(markup: Column, tag: str) -> Column:
    """``first, last, depth, mark`` of every element of one tag, in the order in which they begin.

    ``first`` is the place of its opening mark, counted from 0, ``last`` the place behind its
    closing mark and ``depth`` the number of elements of the tag that are open in it, itself
    included; ``mark`` is the opening mark. As with a stack, a closing mark ends the element
    that was opened last. One that ends none is passed over, and what is never closed
    reaches to the end of the document.
    """
    edges = P.tag_edges(tag)

    def extents(found: Column) -> Column:
        marks, pieces = found["marks"], found["pieces"]
        closes = F.transform(marks, lambda mark: mark.startswith("</"))
        ends = running(F.transform(marks, lambda mark, i: (F.length(F.get(pieces, i)) + F.length(mark)).cast("long")))
        depths = running(F.transform(closes, lambda close: F.when(close, F.lit(-1)).otherwise(1).cast("long")))
        placed = F.transform(
            F.arrays_zip(marks.alias("mark"), closes.alias("close"), ends.alias("end"), depths.alias("at")),
            # What a stray closing mark takes away is given back; a closing mark stands at the depth it ends.
            lambda x: F.struct(
                (x["at"]["total"] - x["at"]["low"] + F.when(x["close"], 1).otherwise(0)).cast("int").alias("depth"),
                x["end"]["total"].cast("int").alias("end"),
                x["close"].alias("close"),
                x["mark"].alias("mark"),
            ),
        )
        return let(placed, lambda p: let(F.array_sort(F.filter(p, stands(p))), paired))

    def stands(placed: Column) -> Callable[[Column, Column], Column]:
        """Whether a mark opens an element or closes one that is open."""

        def test(x: Column, i: Column) -> Column:
            before = F.get(placed, i - 1)
            left_open = before["depth"] - F.when(before["close"], 1).otherwise(0)
            return ~x["close"] | (x["depth"] > 1) | F.coalesce((i > 0) & (left_open > 0), F.lit(False))

        return test

    def paired(ordered: Column) -> Column:
        # Of one depth, opening and closing marks take turns.
        def element(x: Column, i: Column) -> Column:
            after = F.get(ordered, i + 1)
            closed = after["close"] & (after["depth"] == x["depth"])
            return F.struct(
                (x["end"] - F.length(x["mark"])).alias("first"),
                F.when(closed, after["end"]).otherwise(F.length(markup)).alias("last"),
                x["depth"].alias("depth"),
                x["mark"].alias("mark"),
                x["close"].alias("close"),
            )

        found = F.filter(F.transform(ordered, element), lambda x: ~x["close"])
        return F.array_sort(
            F.transform(found, lambda x: F.struct(x["first"], x["last"], x["depth"], x["mark"]))
        )

    found = F.struct(
        all_matches(markup, edges, 0).alias("marks"), F.split(markup, edges, -1).alias("pieces")
    )
    return let(found, extents)


def elements(docs: DataFrame, tag: str) -> DataFrame:
    """``doc_id, pos, first, last, depth`` of every element of one tag; see :func:`elements_of`.

    Places count the characters of the document without comments and what scripts and
    styles hold.
    """
    found = with_markup(docs).select("doc_id", F.posexplode(elements_of(F.col("markup"), tag)).alias("pos", "at"))
    return found.select("doc_id", "pos", "at.first", "at.last", "at.depth")


def hidden_block(markup: Column, tag: str = "div") -> Column:
    """What the first hidden element holds, elements inside it included; NULL where there is none."""
    hidden = F.filter(elements_of(markup, tag), lambda x: x["mark"].rlike(P.HIDDEN))

    def inner(x: Column) -> Column:
        begin = x["first"] + F.length(x["mark"])
        whole = F.substring(markup, begin + 1, x["last"] - begin)
        return F.regexp_replace(whole, rf"(?i)</{tag}\s*>$", "")

    return let(F.get(hidden, F.lit(0)), lambda x: F.when(x.isNotNull(), inner(x)))


def preheader(docs: DataFrame) -> DataFrame:
    """``doc_id, preheader``: text of the whole first hidden block; empty where there is none."""
    text = squeeze(F.regexp_replace(hidden_block(F.col("markup")), P.TAG, " "))
    return with_markup(docs).select("doc_id", F.coalesce(text, F.lit("")).alias("preheader"))


def comment_header(docs: DataFrame) -> DataFrame:
    """``doc_id, subject, preheader`` as noted in the first comment; empty where absent."""
    header = F.regexp_extract("html", P.FIRST_COMMENT, 1)
    return docs.select(
        "doc_id",
        subject_of(F.col("html")).alias("subject"),
        F.trim(F.regexp_extract(header, P.COMMENT_PREHEADER, 1)).alias("preheader"),
    )


def hrefs_of(html: Column) -> Column:
    """Targets of the anchors; none in comments and scripts."""
    return F.transform(all_matches(markup(html), P.ANCHOR_HREF), unquote)


def images_of(html: Column) -> Column:
    """The image tags; none in comments and scripts."""
    return all_matches(markup(html), P.IMG, 0)


def anchors_of(html: Column) -> Column:
    """``href, text`` of the anchors that have a target."""
    pieces = F.filter(F.split(markup(html), P.ANCHOR_START), lambda s, i: i > 0)
    segments = F.transform(pieces, lambda s: F.concat(F.lit(" "), s))
    anchors = F.transform(
        segments,
        lambda s: F.struct(
            unquote(F.regexp_extract(s, P.SEGMENT_HREF, 1)).alias("href"),
            squeeze(F.regexp_replace(F.regexp_extract(s, P.SEGMENT_TEXT, 1), P.TAG, " ")).alias("text"),
        ),
    )
    return F.filter(anchors, lambda a: a["href"].isNotNull())


def links(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, href`` of every anchor that has a target."""
    return docs.select("doc_id", F.posexplode(hrefs_of(F.col("html"))).alias("pos", "href"))


def link_texts(docs: DataFrame) -> DataFrame:
    """As :func:`links`, with the words shown for each link."""
    targets = anchors_of(F.col("html"))
    return docs.select("doc_id", F.posexplode(targets).alias("pos", "link")).select(
        "doc_id", "pos", "link.href", "link.text"
    )


def images(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, src, alt, width``; NULL for an attribute the tag lacks."""
    tags = docs.select("doc_id", F.posexplode(images_of(F.col("html"))).alias("pos", "tag"))
    return tags.select(
        "doc_id", "pos", *(attribute(F.col("tag"), a).alias(a) for a in ("src", "alt", "width"))
    )


def visible_text(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: the prose, without tags, comments, styles, scripts and title.

    A hidden preheader and undecoded entities stay in.
    """
    return docs.select("doc_id", visible_text_of(F.col("html")).alias("text"))


def text_stats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_chars`` of the visible text."""
    return visible_text(docs).select(
        "doc_id",
        count_words(F.col("text")).alias("n_words"),
        F.length("text").alias("n_chars"),
    )


def stats_by_language(docs: DataFrame) -> DataFrame:
    """``lang, n_docs, avg_words, max_words``; counted per task before the shuffle."""
    html = F.col("html")
    texts = docs.select(lang_of(markup(html)).alias("lang"), visible_text_of(html).alias("text"))
    counted = texts.select("lang", count_words(F.col("text")).alias("n_words"))
    return counted.groupBy("lang").agg(
        F.count("*").alias("n_docs"),
        F.round(F.avg("n_words"), 4).alias("avg_words"),
        F.max("n_words").alias("max_words"),
    )


def sections(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, name`` of every comment written on one line."""
    names = all_matches(F.col("html"), P.COMMENT_LINE)
    return docs.select("doc_id", F.posexplode(names).alias("pos", "name"))


def merge_tags(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, n``: placeholders to be filled per recipient; counted within the row."""
    tags = counts(all_matches(F.col("html"), P.MERGE_TAG))
    return docs.select("doc_id", F.inline(tags)).withColumnRenamed("value", "tag")


def prices(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, amount`` of every euro amount; none in comments, scripts and styles."""
    found = all_matches(markup(F.col("html")), P.PRICE)
    amounts = docs.select("doc_id", F.posexplode(found).alias("pos", "written"))
    return amounts.select("doc_id", "pos", decimal_amount(F.col("written")).alias("amount"))


def pack_prices(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, units, total, stated, computed, agrees`` of offers of n pages for a sum.

    ``stated`` is the price per page where the offer gives one; ``computed`` is
    the sum over the pages, to the cent.
    """
    found = docs.select(
        "doc_id", F.posexplode(all_matches(markup(F.col("html")), P.PACK_PRICE, 0)).alias("pos", "offer")
    )
    parts = found.select(
        "doc_id",
        "pos",
        F.regexp_extract("offer", P.PACK_PRICE, 1).try_cast("int").alias("units"),
        decimal_amount(F.regexp_extract("offer", P.PACK_PRICE, 2)).alias("total"),
        decimal_amount(F.regexp_extract("offer", P.PACK_PRICE, 3)).alias("stated"),
    )
    computed = F.round(F.try_divide(F.col("total"), F.col("units")), 2).cast("decimal(10,2)")
    return parts.withColumn("computed", computed).withColumn(
        "agrees", F.col("stated") == F.col("computed")
    )
