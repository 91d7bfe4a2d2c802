"""Links and images of documents, and of link tables ``(doc_id, pos, href)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.functions import patterns as P
from folioscan.functions.columns import attribute, let, occurrences
from folioscan.operators.extract import anchors_of, hrefs_of, images_of


def classify_links(links: DataFrame) -> DataFrame:
    """Adds ``scheme, host, kind``.

    ``kind`` is placeholder, mailto, tel, web, relative or other.
    """
    href = F.col("href")
    scheme = F.lower(F.regexp_extract("href", P.SCHEME, 1))
    host = F.regexp_extract(F.lower(href), P.HOST, 1)
    typed = links.withColumns({"scheme": scheme, "host": host})
    kind = (
        F.when(href.rlike(P.MERGE_TAG), "placeholder")
        .when(F.col("scheme").isin("mailto", "tel"), F.col("scheme"))
        .when(F.col("host") != "", "web")
        .when(F.col("scheme") == "", "relative")
        .otherwise("other")
    )
    return typed.withColumn("kind", kind)


def mailto_subjects(links: DataFrame) -> DataFrame:
    """``doc_id, pos, subject`` of mail links that set a subject, percent-decoded.

    A plus sign stays a plus sign, as mail links mean it; NULL where the
    escapes are not valid.
    """
    is_mail = F.lower(F.regexp_extract("href", P.SCHEME, 1)) == "mailto"
    encoded = F.when(is_mail, F.regexp_extract("href", P.MAIL_SUBJECT, 1)).otherwise("")
    # Unfolded rather than filtered: a filter would match the patterns a second time.
    subjects = F.filter(F.array(encoded), lambda subject: subject != "")
    return links.select("doc_id", "pos", F.explode(subjects).alias("encoded")).select(
        "doc_id",
        "pos",
        F.try_url_decode(F.replace("encoded", F.lit("+"), F.lit("%2B"))).alias("subject"),
    )


def link_domains(docs: DataFrame) -> DataFrame:
    """``host, n_links, n_docs`` of the links of ``docs(doc_id, html)`` that name a host."""
    return host_counts(docs.select(hrefs_of(F.col("html")).alias("hrefs")))


def host_counts(lists: DataFrame) -> DataFrame:
    """``host, n_links, n_docs`` of ``lists(hrefs)``, which has the targets of one document in each row.

    One shuffle, of partial counts per host: a host that a third of all links
    name reaches its task as a few of them.
    """
    hosts = F.transform("hrefs", lambda href: F.regexp_extract(F.lower(href), P.HOST, 1))
    named = F.filter(hosts, lambda host: host != "")
    marks = lists.select(F.inline(occurrences(named)))
    return marks.groupBy(F.col("value").alias("host")).agg(
        F.sum("n").alias("n_links"), F.sum("d").alias("n_docs")
    )


def shared_links(docs: DataFrame) -> DataFrame:
    """``url, n_docs`` of link targets that more than one document has."""
    return _shared(docs.select(F.explode(F.array_distinct(hrefs_of(F.col("html")))).alias("url")))


def shared_images(docs: DataFrame) -> DataFrame:
    """``url, n_docs`` of images that more than one document shows; an image without source counts as NULL."""
    sources = F.transform(images_of(F.col("html")), lambda tag: attribute(tag, "src"))
    return _shared(docs.select(F.explode(F.array_distinct(sources)).alias("url")))


def _shared(urls: DataFrame) -> DataFrame:
    """Each url is listed once for a document, so one count per url is enough."""
    used = urls.groupBy("url").agg(F.count(F.lit(1)).alias("n_docs"))
    return used.where(F.col("n_docs") > 1)


def paired_links(
    docs: DataFrame, before: str = P.BEFORE_LABEL, after: str = P.AFTER_LABEL
) -> DataFrame:
    """``doc_id, pair, before_href, after_href``: a "before" link and the "after" link next to it.

    Neighbours are compared within the row.
    """

    def pairs(anchors: Column) -> Column:
        neighbours = F.transform(
            anchors, lambda link, i: F.struct(link.alias("link"), F.get(anchors, i + 1).alias("next"))
        )
        adjacent = F.filter(
            neighbours,
            lambda p: (p["link"]["text"] == before) & F.coalesce(p["next"]["text"] == after, F.lit(False)),
        )
        return F.transform(
            adjacent,
            lambda p: F.struct(p["link"]["href"].alias("before"), p["next"]["href"].alias("after")),
        )

    found = docs.select("doc_id", F.posexplode(let(anchors_of(F.col("html")), pairs)).alias("pair", "at"))
    return found.select(
        "doc_id", "pair", F.col("at.before").alias("before_href"), F.col("at.after").alias("after_href")
    )
