"""Connected components of a table of links, and of one that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.session import staged


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that can be reached, for every node of ``links(a, b)``.

    Star contraction (Kiveris et al. 2014). Links are kept from the larger node to the
    smaller one. The large star hangs the larger neighbours of each node on the least node
    around it; the small star hangs a node and its smaller neighbours on the least of them.
    Both keep what is connected, and neither makes more links than there are, so a round
    costs two groupings of the links however large a component is. The rounds end when every
    link leads to a root; their number grows with the logarithm of the longest chain.
    """
    edges = staged(
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
        .distinct(),
        "edges",
    )
    alone = links.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"), F.col("a").alias("root"))
    while not _is_stars(edges):
        edges = _small_star(_large_star(edges))
    centres = edges.select(F.col("root").alias("node"), "root").unionAll(alone.select("node", "root")).distinct()
    lone = centres.join(edges.select("node"), "node", "left_anti")
    return edges.unionAll(lone)


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one link, and leads to a node that has none."""
    counted = edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("node").alias("nodes")).first()
    if counted["n"] != counted["nodes"]:
        return False
    return edges.join(edges.select(F.col("node").alias("root")), "root", "left_semi").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node, linked to the least node around it, the node included."""
    around = edges.select(F.col("root").alias("of"), F.col("node").alias("other"))
    both = around.unionAll(edges.select(F.col("node").alias("of"), F.col("root").alias("other")))
    # Aggregated and staged, so that a node with a large part of the links is split where it is joined.
    least = staged(
        both.groupBy("of").agg(F.min("other").alias("least")).select("of", F.least("of", "least").alias("least")),
        "least",
    )
    hung = around.join(least, "of").select(F.col("other").alias("node"), F.col("least").alias("root"))
    return staged(hung.distinct(), "edges")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours, linked to the least of them."""
    least = staged(edges.groupBy("node").agg(F.min("root").alias("least")), "least")
    hung = (
        edges.join(least, "node")
        .where(F.col("root") != F.col("least"))
        .select(F.col("root").alias("node"), F.col("least").alias("root"))
    )
    return staged(hung.unionAll(least.select("node", F.col("least").alias("root"))).distinct(), "edges")


def with_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The ``node, root`` of an earlier result, with further ``links(a, b)`` that join and add nodes.

    The links are led to the roots of their ends first, so what is contracted is the new
    links between earlier components and new nodes; of the earlier nodes only those are
    touched whose root has changed.
    """
    of_a = roots.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
    of_b = roots.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
    ends = (
        links.select("a", "b")
        .join(of_a, "a", "left")
        .join(of_b, "b", "left")
        .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    )
    moved = staged(components(ends.distinct()), "moved")
    to = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
    kept = roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return kept.unionAll(moved.join(roots.select("node"), "node", "left_anti"))
