"""Tags, nesting, colours, fonts and style classes of ``docs(doc_id, html)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import patterns as P
from folioscan.functions.columns import all_matches, counts, live, markup, most_frequent, occurrences, squeeze, unquote


def tags_of(html: Column) -> Column:
    """Names of the opening tags, in order; none in comments and scripts."""
    return F.transform(all_matches(markup(html), P.TAG_NAME), F.lower)


def tag_histogram(docs: DataFrame) -> DataFrame:
    """``tag, n, n_docs``: one shuffle, of partial counts per tag."""
    marks = docs.select(F.inline(occurrences(tags_of(F.col("html")))))
    return marks.groupBy(F.col("value").alias("tag")).agg(
        F.sum("n").alias("n"), F.sum("d").alias("n_docs")
    )


def doc_tags(docs: DataFrame) -> DataFrame:
    """``doc_id, tag, n``; counted within the row."""
    found = docs.select("doc_id", F.inline(counts(tags_of(F.col("html")))))
    return found.withColumnRenamed("value", "tag")


def top_tags(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, tag, n, rank`` of the k most frequent tags of each document."""
    return _top(docs, tags_of(F.col("html")), "tag", k)


def nesting_depth(docs: DataFrame, tag: str) -> DataFrame:
    """``doc_id, max_depth`` of one tag: opening less closing marks, as written.

    Folded within the row, so nothing is shuffled or sorted. Tags in comments and
    scripts do not count; unclosed tags are not repaired. A document without the
    tag has depth 0.
    """
    marks = all_matches(markup(F.col("html")), P.tag_edges(tag))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"))

    def step(state: Column, mark: Column) -> Column:
        depth = state["depth"] + F.when(mark == "", 1).otherwise(-1)
        return F.struct(depth.alias("depth"), F.greatest(state["deepest"], depth).alias("deepest"))

    deepest = F.aggregate(marks, start, step, lambda state: state["deepest"])
    return docs.select("doc_id", deepest.alias("max_depth"))


def colours_of(html: Column) -> Column:
    """Six-digit colours of text, attributes and styles; none in comments and scripts."""
    found = F.filter(all_matches(live(html), P.COLOUR), lambda colour: colour != "")
    return F.transform(found, F.lower)


def palette(docs: DataFrame) -> DataFrame:
    """``doc_id, colour, n`` of six-digit colours; counted within the row."""
    found = docs.select("doc_id", F.inline(counts(colours_of(F.col("html")))))
    return found.withColumnRenamed("value", "colour")


def top_colours(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, colour, n, rank`` of the k most frequent colours of each document."""
    return _top(docs, colours_of(F.col("html")), "colour", k)


def _top(docs: DataFrame, values: Column, name: str, k: int) -> DataFrame:
    found = docs.select("doc_id", F.posexplode(most_frequent(values, k)).alias("place", "at"))
    return found.select(
        "doc_id", F.col("at.value").alias(name), F.col("at.n").alias("n"), (F.col("place") + 1).alias("rank")
    )


def font_stacks(docs: DataFrame) -> DataFrame:
    """``font_stack, n_docs`` of style attributes and style blocks."""
    html = F.col("html")
    attributes = F.transform(all_matches(markup(html), P.STYLE_ATTRIBUTE), unquote)
    styles = F.array_join(F.concat(attributes, all_matches(html, P.STYLE_BLOCK)), ";")
    stacks = F.array_distinct(F.transform(all_matches(styles, P.FONT_STACK), squeeze))
    return (
        docs.select(F.explode(stacks).alias("font_stack"))
        .groupBy("font_stack")
        .agg(F.count("*").alias("n_docs"))
    )


def defined_classes(html: Column) -> Column:
    """Class names in the selectors of the style blocks, one per rule."""
    css = F.array_join(all_matches(html, P.STYLE_BLOCK), "\n")
    return all_matches(F.regexp_replace(css, P.CSS_NOISE, " "), P.CSS_CLASS)


def used_classes(html: Column) -> Column:
    """Class names in class attributes."""
    values = F.transform(all_matches(markup(html), P.CLASS_ATTRIBUTE), unquote)
    return F.split(squeeze(F.array_join(values, " ")), " ")


def unused_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class`` defined in a style block and used nowhere; compared within the row."""
    unused = F.array_except(defined_classes(F.col("html")), used_classes(F.col("html")))
    return docs.select("doc_id", F.explode(unused).alias("class"))


def duplicate_rules(docs: DataFrame) -> DataFrame:
    """``doc_id, class, n`` of classes with more than one rule."""
    several = F.filter(counts(defined_classes(F.col("html"))), lambda rule: rule["n"] > 1)
    return docs.select("doc_id", F.inline(several)).withColumnRenamed("value", "class")
