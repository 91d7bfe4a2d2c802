"""Queries over the ``pages`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.functions import columns
from folioscan.functions import patterns as P
from folioscan.operators import extract, links, markup
from folioscan.plans import query as q
from folioscan.plans.query import Query
from folioscan.session import scratch_path
from folioscan.sources import read_pages, read_written, write_docs

PAGES = "(SELECT page_id AS doc_id, html FROM pages)"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return links.host_counts(urls.select(F.array("url").alias("hrefs")))


def written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus, written by language to the shared folder and read back."""
    path = scratch_path(spark, "pages_by_lang")
    docs = pages(spark, sf_dir).withColumn("lang", extract.lang_of(columns.markup(F.col("html"))))
    write_docs(docs, path, by="lang")
    return read_written(spark, path, docs.schema)


METADATA_SQL = f"""
    SELECT doc_id, {q.squeezed(q.extract('plain', P.TITLE))} AS title,
           coalesce({q.unquoted(q.extract('plain', P.LANG))}, '') AS lang
    FROM (SELECT doc_id, {q.markup('html')} AS plain FROM {PAGES})"""

TEXT_SQL = f"SELECT doc_id, {q.visible('html')} AS text FROM {PAGES}"

STATS_SQL = f"""
    SELECT doc_id, CAST(len({q.word_list('text')}) AS INTEGER) AS n_words,
           CAST(length(text) AS INTEGER) AS n_chars FROM ({TEXT_SQL})"""

QUERIES = {
    "doc_metadata": Query(lambda s, d: extract.doc_metadata(pages(s, d)), METADATA_SQL),
    "links": Query(lambda s, d: extract.links(pages(s, d)), q.links(PAGES)),
    "link_texts": Query(lambda s, d: extract.link_texts(pages(s, d)), q.link_texts(PAGES)),
    "classify_links": Query(
        lambda s, d: links.classify_links(extract.links(pages(s, d))), q.classified(q.links(PAGES))
    ),
    "shared_links": Query(
        lambda s, d: links.shared_links(pages(s, d)),
        f"""SELECT href AS url, count(DISTINCT doc_id) AS n_docs FROM ({q.links(PAGES)})
            GROUP BY href HAVING count(DISTINCT doc_id) > 1""",
    ),
    "page_domains": Query(
        page_hosts,
        f"""SELECT host, count(*) AS n_links, count(DISTINCT page_id) AS n_docs
            FROM (SELECT page_id, {q.extract('lower(url)', P.HOST)} AS host FROM pages)
            WHERE host <> '' GROUP BY host""",
    ),
    "visible_text": Query(lambda s, d: extract.visible_text(pages(s, d)), TEXT_SQL),
    "text_stats": Query(lambda s, d: extract.text_stats(pages(s, d)), STATS_SQL),
    "stats_by_language": Query(
        lambda s, d: extract.stats_by_language(pages(s, d)),
        f"""SELECT lang, count(*) AS n_docs, round(avg(n_words), 4) AS avg_words,
                   max(n_words) AS max_words
            FROM ({METADATA_SQL}) JOIN ({STATS_SQL}) USING (doc_id) GROUP BY lang""",
    ),
    "sections": Query(
        lambda s, d: extract.sections(pages(s, d)),
        q.numbered(PAGES, q.extract_all("html", P.COMMENT_LINE), "name"),
    ),
    "tag_histogram": Query(
        lambda s, d: markup.tag_histogram(pages(s, d)),
        f"""SELECT tag, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_docs
            FROM ({q.doc_tags(PAGES)}) GROUP BY tag""",
    ),
    "doc_tags": Query(lambda s, d: markup.doc_tags(pages(s, d)), q.doc_tags(PAGES)),
    "top_tags": Query(
        lambda s, d: markup.top_tags(pages(s, d), 3),
        q.top_per_doc(q.doc_tags(PAGES), "tag", 3),
    ),
    "nesting_depth_p": Query(
        lambda s, d: markup.nesting_depth(pages(s, d), "p"), q.depth(PAGES, "p")
    ),
    "nesting_depth_b": Query(
        lambda s, d: markup.nesting_depth(pages(s, d), "b"), q.depth(PAGES, "b")
    ),
    "write_docs": Query(
        written_and_read,
        f"SELECT doc_id, html, coalesce({q.unquoted(q.extract(q.markup('html'), P.LANG))}, '') AS lang FROM {PAGES}",
    ),
}
