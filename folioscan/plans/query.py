"""A registered query, and SQL fragments used by several checks."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from folioscan.functions import patterns as P


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def unquoted(value: str) -> str:
    return (
        f"CASE WHEN {value} = '' THEN NULL "
        f"WHEN left({value}, 1) IN ('\"', '''') THEN substr({value}, 2, length({value}) - 2) "
        f"ELSE {value} END"
    )


def squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, {lit(P.SPACES)}, ' ', 'g'))"


def extract(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({text}, {lit(pattern)}, {group})"


def extract_all(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({text}, {lit(pattern)}, {group})"


def visible(html: str) -> str:
    return squeezed(f"regexp_replace({html}, {lit(P.NOT_SHOWN)}, ' ', 'g')")


def word_list(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {lit(P.SPACES)}), lambda w: w <> '')"


def numbered(docs: str, values: str, name: str) -> str:
    """One row per list element with its position from 0."""
    return (
        f"SELECT doc_id, CAST(unnest(range(len(v))) AS INTEGER) AS pos, unnest(v) AS {name} "
        f"FROM (SELECT doc_id, {values} AS v FROM {docs})"
    )


def markup(html: str) -> str:
    """The document without comments and without what scripts and styles hold, in three steps."""
    plain = f"regexp_replace({html}, '<!--.*?-->', '', 'gs')"
    plain = f"regexp_replace({plain}, '(<script[^>]*>).*?</script', '\\1</script', 'gis')"
    return f"regexp_replace({plain}, '(<style[^>]*>).*?</style', '\\1</style', 'gis')"


def links(docs: str) -> str:
    hrefs = f"list_transform({extract_all(markup('html'), P.ANCHOR_HREF)}, lambda x: {unquoted('x')})"
    return numbered(docs, hrefs, "href")


def link_texts(docs: str) -> str:
    tail = "' ' || s"
    text = squeezed(f"regexp_replace({extract(tail, P.SEGMENT_TEXT)}, {lit(P.TAG)}, ' ', 'g')")
    return f"""
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos,
               {unquoted('raw')} AS href, text
        FROM (SELECT doc_id, i, {extract(tail, P.SEGMENT_HREF)} AS raw, {text} AS text
              FROM (SELECT doc_id, unnest(range(len(v))) AS i, unnest(v) AS s
                    FROM (SELECT doc_id, regexp_split_to_array({markup('html')}, {lit(P.ANCHOR_START)}) AS v
                          FROM {docs}))
              WHERE i > 0)
        WHERE raw <> ''"""


def classified(links_sql: str) -> str:
    return f"""
        SELECT *, CASE WHEN regexp_matches(href, {lit(P.MERGE_TAG)}) THEN 'placeholder'
                       WHEN scheme IN ('mailto', 'tel') THEN scheme
                       WHEN host <> '' THEN 'web'
                       WHEN scheme = '' THEN 'relative' ELSE 'other' END AS kind
        FROM (SELECT *, lower({extract('href', P.SCHEME)}) AS scheme,
                     {extract('lower(href)', P.HOST)} AS host FROM ({links_sql}))"""


def doc_tags(docs: str) -> str:
    return f"""
        SELECT doc_id, tag, count(*) AS n
        FROM (SELECT doc_id, lower(unnest({extract_all(markup('html'), P.TAG_NAME)})) AS tag FROM {docs})
        GROUP BY doc_id, tag"""


def top_per_doc(counts: str, value: str, k: int) -> str:
    return f"""
        SELECT doc_id, {value}, n, CAST(rank AS INTEGER) AS rank
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, {value}) AS rank
              FROM ({counts})) WHERE rank <= {k}"""


def depth(docs: str, tag: str) -> str:
    """Opening less closing tags, found by cutting the markup at every "<"."""
    return f"""
        WITH c AS (SELECT doc_id, unnest(string_split({markup('html')}, '<')) AS piece,
                          generate_subscripts(string_split({markup('html')}, '<'), 1) AS place FROM {docs}),
             m AS (SELECT doc_id, place, CASE WHEN piece LIKE '/%' THEN -1 ELSE 1 END AS step
                   FROM c WHERE place > 1 AND contains(piece, '>')
                     AND list_contains(['{tag}', '/{tag}'],
                         lower(split_part(split_part(split_part(replace(piece, chr(10), ' '), '>', 1), ' ', 1), chr(9), 1)))),
             r AS (SELECT doc_id, sum(step) OVER (PARTITION BY doc_id ORDER BY place) AS depth FROM m),
             d AS (SELECT doc_id, max(depth) AS deepest FROM r GROUP BY doc_id)
        SELECT doc_id, CAST(greatest(coalesce(deepest, 0), 0) AS INTEGER) AS max_depth
        FROM {docs} LEFT JOIN d USING (doc_id)"""
