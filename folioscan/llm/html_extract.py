"""Main text of pages by deducing the template of their host.

The tokens of a page are its tags, with class and id, and its runs of text. Tokens
that occur equally often on every page of a host share an occurrence vector and
form an equivalence class. A vector is told by a checksum over pages and counts, so
classes come from one aggregation, and a host with a third of all pages is no
harder than others. The largest class of tags that stand once on nearly every page is
the core of the host's template; its tags, in their order, cut a page into slots. Other
classes with enough support are nested, and so the template's, if they stand in the same
slots on nearly all pages. The main element is that of the template which holds most of the
text in all pages' slots: an ``article`` or ``main`` element, or the innermost one. Pages
without it go by names, then by where most of their own text is. Inside, blocks of
nothing but the template's runs are dropped, and so are elements that by tag, role, class
or id are menus, headers, footers, sidebars, notices, adverts, forms or comments, unless
they hold the main element; the rest is the text. Pages with the same article count as
one. Hosts with few pages use the template of all pages together.

Character references are decoded, white space inside a block becomes one space,
blocks are joined by line breaks in page order. A null or empty page has an empty
text. Pages without a url share one host. Repeated pages are extracted one by one.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import by_batch, slices
from folioscan.session import staged

#: A host needs so many pages for a template of its own.
OWN_PAGES = 5
#: A class is the template's if it stands equally often on so large a share of the pages.
SUPPORT = 0.9
#: A run of text belongs to the template if the host has so many pages at least.
RUN_PAGES = 10
#: Share of the text that an element must hold to be the article's where no tag says so.
MOST_TEXT = 0.8
#: A class needs so many tags to be the core: those of one element.
CORE_TAGS = 2
EVERY_HOST = ""
#: Kinds of candidates: runs, tags, and tags that open elements, by what they say of an article.
RUN, TAG, ELEMENT, KINDS = 0, 1, 2, {"main": 3, "article": 4}
#: Deeper than any element.
DEEP = 1 << 30
SLOTS = ["host", "page", "token", "slots", "kind", "depth", "chars"]
#: Most tokens of templates that are sent to every executor (8 bytes each).
BROADCAST_TOKENS = 1_000_000

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select textarea iframe svg dialog menu".split()
)
ARTICLE = frozenset(["article", "main"])
#: Elements whose text nobody sees, or that are no more than a control.
UNSEEN = frozenset("head script style noscript template button select textarea iframe svg".split())
#: Elements that no class, id or role takes out.
KEPT = ARTICLE | {"body", "html"}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: Parts of class, id and role that name no content, and parts that may stand beside them.
NO_CONTENT = (
    r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|gdpr"
    r"|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pager|pagination|popup|promo\w*|related"
    r"|replies|respond|share|sharing|sidebar|signup|site-?header|social|sponsor\w*|subscribe|toolbar|widgets?)"
)
BESIDE = (
    r"(?:area|bar|block|bottom|box|buttons?|container|form|group|icons?|inner|items?|left|links?|list|main|outer"
    r"|posts?|primary|right|secondary|section|site|slot|thread|top|wrap|wrapper|\d+)"
)
#: A whole word of class, id or role: ``no-sidebar`` and ``share-price`` name something else.
NOT_CONTENT = re.compile(rf"(?:{BESIDE}[-_]+)*{NO_CONTENT}(?:[-_]+(?:{NO_CONTENT}|{BESIDE}))*")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(?P<raw>script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)"
    r"(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?=>|\Z)|[^>]*)(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(
    r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I
)
MARK_NAME = re.compile(r"(?:^|(?<=\s))(?:class|id|role)=")
#: Longest attributes of a tag that is kept once it is parsed.
KEPT_LENGTH = 300
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Token(NamedTuple):
    """A tag or a run of text; ``name`` is empty for text, ``marks`` are class, id and role."""

    name: str
    opens: bool
    marks: str
    text: str

    def key(self) -> int:
        """Signed 64 bits that tell tokens apart."""
        return tag_key(self) if self.name else key_of(" ".join(self.text.split()))


def key_of(shown: str) -> int:
    return xxhash.xxh3_64_intdigest(shown.encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(1 << 14)
def tag_key(token: Token) -> int:
    return key_of(f"<{'' if token.opens else '/'}{token.name} {token.marks}>")


@lru_cache(1 << 14)
def tag(name: str, end: str, attributes: str | None) -> Token:
    marks = ""
    if attributes and not end:
        values = ATTRIBUTE.findall(attributes)
        marks = " ".join(sorted(f"{a.lower()}={''.join(v).strip().lower()}" for a, *v in values))
    return Token(name.lower(), not end, marks, "")


def tokens(html: str) -> list[Token]:
    """Tags and runs of text in order, without comments, scripts and styles."""
    found, end = [], 0
    for match in TOKEN.finditer(html):
        if match.start() > end and not html[end : match.start()].isspace():
            found.append(Token("", False, "", html[end : match.start()]))
        end = match.end()
        name = match["name"]
        if name:
            attributes = match["attributes"]
            kept = tag if not attributes or len(attributes) <= KEPT_LENGTH else tag.__wrapped__
            found.append(kept(name, match["end"], attributes))
    if end < len(html) and not html[end:].isspace():
        found.append(Token("", False, "", html[end:]))
    return found


def not_content(token: Token) -> bool:
    return names_no_content(token.name, token.marks)


@lru_cache(1 << 14)
def names_no_content(name: str, marks: str) -> bool:
    if name in DROPPED or (name == "header" and "entry" not in marks):
        return True
    if not marks or name in KEPT:
        return False
    return any(map(NOT_CONTENT.fullmatch, MARK_NAME.sub(" ", marks).split()))


class Element(NamedTuple):
    """An element of a page: the places of its tags."""

    first: int
    last: int
    name: str


def elements(page: list[Token]) -> list[Element]:
    """All elements, outer ones first where they begin together."""
    stack: list[tuple[int, str]] = []
    found: list[Element] = []
    for at, token in enumerate(page):
        if not token.name or token.name in VOID:
            continue
        if token.opens:
            stack.append((at, token.name))
        elif stack and stack[-1][1] == token.name or any(name == token.name for _, name in stack):
            name = ""
            while name != token.name:
                first, name = stack.pop()
                found.append(Element(first, at, name))
    found += [Element(first, len(page), name) for first, name in stack]
    return sorted(found, key=lambda e: (e.first, -e.last))


def text_before(page: list[Token], gone: list[bool]) -> list[int]:
    """Characters of text that is not gone, before every token and at the end."""
    sizes = [0]
    for token, out in zip(page, gone):
        sizes.append(sizes[-1] + (0 if out or token.name else len(token.text)))
    return sizes


def marked(page: list[Token], spans: list[Element]) -> list[bool]:
    """The tokens in one of the spans."""
    edges = [0] * (len(page) + 1)
    for e in spans:
        edges[e.first] += 1
        edges[e.last] -= 1
    depth, found = 0, []
    for edge in edges[:-1]:
        depth += edge
        found.append(depth > 0)
    return found


def left_out(page: list[Token], parts: list[Element], main: Element | None = None) -> list[bool]:
    """The tokens of elements that are no content; what holds the main element stays.

    Where no template tells the main element, what holds most of the page's text stays,
    unless the page's articles are elsewhere.
    """
    named = [e for e in parts if not_content(page[e.first])]
    if main:
        return marked(page, [e for e in named if not e.first <= main.first < e.last])
    wide = [e for e in named if page[e.first].name not in UNSEEN]
    if wide:
        sizes = text_before(page, marked(page, [e for e in named if page[e.first].name in UNSEEN]))
        articles = [e.first for e in parts if e.name in ARTICLE]
        stays = {
            e
            for e in wide
            if sizes[e.last] - sizes[e.first] >= MOST_TEXT * sizes[-1] > 0
            and (not articles or any(e.first < at < e.last for at in articles))
        }
        named = [e for e in named if e not in stays]
    return marked(page, named)


def main_element(page: list[Token], parts: list[Element], main: int | None) -> Element | None:
    """The page's element that the template calls the main one."""
    if main is None:
        return None
    return next((e for e in parts if page[e.first].key() == main), None)


def outermost(parts: list[Element]) -> list[tuple[int, int]]:
    """The spans of the articles among the elements, or else of all, without those inside others."""
    spans, end = [], -1
    for e in [e for e in parts if e.name == "article"] or parts:
        if e.first > end:
            spans.append((e.first, e.last))
            end = e.last
    return spans


def region(
    page: list[Token], parts: list[Element], dropped: list[bool], tags: set[int], main: Element | None = None
) -> list[tuple[int, int]]:
    """The spans of tokens that hold the article.

    They are the template's main element, or the articles that hold most of it. Names, and
    then the template's tags and the page's own text, decide where it has none.
    """
    named = [e for e in parts if e.name in ARTICLE and not dropped[e.first]]
    sizes = text_before(page, dropped)
    if main:
        if main.name in ARTICLE:
            return [(main.first, main.last)]
        spans = outermost([e for e in named if main.first < e.first < main.last])
        held = sum(sizes[last] - sizes[first] for first, last in spans)
        return spans if 2 * held > sizes[main.last] - sizes[main.first] else [(main.first, main.last)]
    once = [e for e in named if page[e.first].key() in tags]
    if named:
        return outermost(once or named)
    inner = [
        e for e in parts if sizes[e.last] - sizes[e.first] >= MOST_TEXT * sizes[-1] and page[e.first].key() in tags
    ]
    best = min(inner, key=lambda e: (e.last - e.first, e.first), default=None)
    return [(best.first, best.last)] if best else [(0, len(page))]


def main_text(html: str, tags: set[int], runs: set[int], main: int | None = None) -> str:
    """The article of one page, given the tags, the runs and the main element of its host's template."""
    page = tokens(html)
    if not page:
        return ""
    parts = elements(page)
    element = main_element(page, parts, main)
    dropped = left_out(page, parts, element)
    blocks: list[list[Token]] = [[]]
    for first, last in region(page, parts, dropped, tags, element):
        blocks.append([])
        for at in range(first, last):
            token = page[at]
            if token.name:
                if token.name not in INLINE:
                    blocks.append([])
            elif not dropped[at]:
                blocks[-1].append(token)
    own = (b for b in blocks if not (runs and all(token.key() in runs for token in b)))
    lines = (" ".join("".join(unescape(token.text) for token in b).split()) for b in own)
    return "\n".join(line for line in lines if line)


def content_key(page: list[Token], keys: list[int], parts: list[Element], dropped: list[bool]) -> int:
    """A digest of the runs of text that seem to be the article's, before any template is known."""
    every = {key for key, token in zip(keys, page) if token.name}
    spans = region(page, parts, dropped, every)
    shown = [keys[at] for span in spans for at in range(*span) if not page[at].name and not dropped[at]]
    return xxhash.xxh3_64_intdigest(array("q", shown).tobytes()) - (1 << 63)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def occurrences(pages: DataFrame) -> DataFrame:
    """``host, page, token, is_run, n, place``: how often each token stands on a page, and where first.

    Pages of a host with the same article count as one, so that copies of an article do
    not make it a template; the copy with a token fewest times says how often. Token 0
    stands for the page itself.
    """
    given = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, keys, names, is_run, counts, places = [], [], [], [], [], []
        for host, html in zip(*(batch.column(i).to_pylist() for i in range(2))):
            page = tokens(html)
            shown = [token.key() for token in page]
            parts = elements(page)
            key = content_key(page, shown, parts, left_out(page, parts))
            found = Counter(shown)
            found[0] = 1
            first = {token: at for at, token in zip(range(len(shown) - 1, -1, -1), reversed(shown))}
            first[0] = 0
            hosts += [host] * len(found)
            keys += [key] * len(found)
            names += found
            is_run += [token != 0 and not page[first[token]].name for token in found]
            counts += found.values()
            places += [first[token] for token in found]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(hosts, pa.string()),
                pa.array(keys, pa.int64()),
                pa.array(names, pa.int64()),
                pa.array(is_run, pa.bool_()),
                pa.array(counts, pa.int32()),
                pa.array(places, pa.int32()),
            ],
            ["host", "page", "token", "is_run", "n", "place"],
        )

    found = by_batch(given, compute, "host string, page long, token long, is_run boolean, n int, place int")
    return found.groupBy("host", "page", "token", "is_run").agg(F.min("n").alias("n"), F.min("place").alias("place"))


def candidates(pages: DataFrame) -> DataFrame:
    """``host, core, tags, runs``: the accepted classes of each host; ``EVERY_HOST`` has those of all.

    A token counts with the pages that hold it as often as most do, so that a page
    on which a line stands once more takes it out of no template. Classes are told
    by that number and by the number of pages and a checksum over them. The largest
    class of tags that stand once is the core, in the order of its tags; of the
    other classes with enough support the slots are still to be compared.
    """
    by_token = ["token", "is_run"]
    found = staged(
        occurrences(pages)
        .groupBy("host", *by_token, "n")
        .agg(
            F.count(F.lit(1)).alias("n_pages"),
            F.bit_xor(F.xxhash64("page")).alias("vector"),
            F.sum("place").alias("places"),
        )
        # A token of one page says nothing of a template; 0 counts the pages.
        .where((F.col("n_pages") > 1) | ~F.col("is_run")),
        "tokens",
    )
    everywhere = (
        found.where(~F.col("is_run"))
        .groupBy(*by_token, "n")
        .agg(F.sum("n_pages").alias("n_pages"), F.bit_xor("vector").alias("vector"), F.sum("places").alias("places"))
        .select(F.lit(EVERY_HOST).alias("host"), *by_token, "n", "n_pages", "vector", "places")
    )
    named = found.where(F.col("host") != EVERY_HOST).unionByName(everywhere)
    pages_of = named.where(F.col("token") == 0).select("host", F.col("n_pages").alias("of"))
    often = (
        named.where((F.col("n_pages") > 1) & (F.col("token") != 0))
        .groupBy("host", *by_token)
        .agg(F.max(F.struct("n_pages", -F.col("n"), "n", "vector", "places")).alias("most"))
        .select("host", *by_token, "most.n", "most.n_pages", "most.vector", (F.col("most.places") / F.col("most.n_pages")).alias("place"))
    )
    # Tags that stand several times on a page enclose nothing that is there once.
    is_tag = ~F.col("is_run") & (F.col("n") == 1)
    classes = (
        often.groupBy("host", "n", "vector", "n_pages")
        .agg(
            F.array_sort(F.collect_list(F.when(is_tag, F.struct("place", "token")))).alias("tags"),
            F.collect_list(F.when(F.col("is_run"), F.col("token"))).alias("runs"),
        )
        .join(pages_of, "host")
        .where(F.col("n_pages") >= SUPPORT * F.col("of"))
        .where((F.col("of") >= OWN_PAGES) | (F.col("host") == EVERY_HOST))
        .select("host", "of", "n_pages", "vector", F.col("tags.token").alias("tags"), "runs")
    )
    none = F.array().cast("array<bigint>")
    core = F.max(F.when(F.size("tags") >= CORE_TAGS, F.struct(F.size("tags"), "n_pages", "vector", "tags"))).alias("core")
    runs = F.when(F.col("of") >= RUN_PAGES, F.col("runs")).otherwise(none)
    accepted = classes.groupBy("host").agg(
        core, F.flatten(F.collect_list("tags")).alias("tags"), F.flatten(F.collect_list(runs)).alias("runs")
    )
    inside = F.coalesce("core.tags", none)
    return accepted.select("host", inside.alias("core"), F.array_except("tags", inside).alias("tags"), "runs")


def in_order(ranks: list[int]) -> list[bool]:
    """Which of the ranks are in a longest increasing part."""
    ends, at_end, before = [], [], []
    for i, rank in enumerate(ranks):
        k = bisect_left(ends, rank)
        ends[k:], at_end[k:] = [rank, *ends[k + 1 :]], [i, *at_end[k + 1 :]]
        before.append(at_end[k - 1] if k else -1)
    found = [False] * len(ranks)
    i = at_end[-1] if at_end else -1
    while i >= 0:
        found[i], i = True, before[i]
    return found


def slots_of(html: str, core: list[int], tags: set[int], runs: set[int]) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """The page's content, and ``token, slots, kind, depth, chars`` of its candidates; token 0 has all text.

    ``slots`` is 1 for a tag of the core in its place and 0 for another one, and for the rest
    a checksum over the gaps of the core in which the token stands. ``chars`` counts the text
    that a tag's element holds beside candidates.
    """
    page = tokens(html)
    keys = [token.key() for token in page]
    rank_of = {token: rank for rank, token in enumerate(core)}
    cores = [at for at, key in enumerate(keys) if key in rank_of]
    kept = {at for at, ok in zip(cores, in_order([rank_of[keys[at]] for at in cores])) if ok}
    parts = elements(page)
    dropped = left_out(page, parts)
    sizes = text_before(page, [gone or key in runs for gone, key in zip(dropped, keys)])
    told = {keys[at]: 0 for at in cores} | {keys[at]: 1 for at in kept}
    slots: dict[int, list[int]] = {}
    slot = -1
    for at, key in enumerate(keys):
        if at in kept:
            slot = rank_of[key]
        elif key in tags or key in runs:
            slots.setdefault(key, []).append(slot)
    for key, found in slots.items():
        told[key] = xxhash.xxh3_64_intdigest(",".join(map(str, found)).encode()) - (1 << 63)
    # The least depth over the pages counts, so what opens no element here has none that is less.
    rows = {key: (key, of, RUN if key in runs else TAG, DEEP, 0) for key, of in told.items()}
    ends: list[int] = []
    for e in parts:
        while ends and ends[-1] <= e.first:
            ends.pop()
        key = keys[e.first]
        if e.first in kept or len(slots.get(key, ())) == 1:
            rows[key] = (key, told[key], KINDS.get(e.name, ELEMENT), len(ends), sizes[e.last] - sizes[e.first])
        ends.append(e.last)
    return content_key(page, keys, parts, dropped), [(0, 0, TAG, 0, sizes[-1]), *rows.values()]


def with_templates(pages: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    """The pages with the columns of their host's template."""
    given = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    own = found.where(F.col("host") != EVERY_HOST)
    sizes = [F.coalesce(F.size(name), F.lit(0)) for name, kind in own.dtypes if kind.startswith("array")]
    size = own.agg(F.sum(sum(sizes, F.lit(1)))).first()[0] or 0
    # Beyond the bound the pages are dealt by host, and adaptive execution splits large hosts.
    own = F.broadcast(own) if size <= BROADCAST_TOKENS else own
    return given.join(own.select("host", F.lit(True).alias("own"), *columns), "host", "left")


def templates(pages: DataFrame) -> DataFrame:
    """``host, main, tags, runs``: each host's template; ``EVERY_HOST`` has that of all.

    A candidate is nested, and so the template's, if it stands in the same slots of the core
    on nearly all pages. The main element is the innermost one that holds most of the
    text in the slots of all pages, or the article or main element that does.
    """
    sets = staged(candidates(pages), "classes")
    every = sets.where(F.col("host") == EVERY_HOST).collect()
    general = (every[0]["core"], set(every[0]["tags"]), set()) if every else ([], set(), set())
    given = with_templates(pages, sets, "core", "tags", "runs").select("host", "own", "html", "core", "tags", "runs")

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for host, own, html, core, tags, runs in zip(*(column.to_pylist() for column in batch.columns)):
            classes = (core, set(tags), set(runs)) if own else general
            page, shown = slots_of(html, *classes)
            rows += [(host if own else EVERY_HOST, page, *row) for row in shown]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        columns = zip(*rows) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], SLOTS)

    shown = by_batch(given, compute, "host string, page long, token long, slots long, kind int, depth int, chars long")
    by_token = ["host", "token"]
    nested = (
        shown.groupBy("host", "page", "token")
        .agg(F.max(F.struct("slots", "kind", "depth", "chars")).alias("one"))
        .select(*by_token, "one.*")
        .groupBy(*by_token, "slots")
        .agg(F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind"), F.min("depth").alias("depth"), F.sum("chars").alias("chars"))
        .groupBy(*by_token)
        .agg(
            F.max(F.struct("n", "slots")).alias("most"),
            F.sum("n").alias("of"),
            F.max("kind").alias("kind"),
            F.min("depth").alias("depth"),
            F.sum("chars").alias("chars"),
        )
        .where((F.col("most.n") >= SUPPORT * F.col("of")) & ((F.col("token") == 0) | (F.col("most.slots") != 0)))
    )
    listed = nested.groupBy("host").agg(
        F.max(F.when(F.col("token") == 0, F.col("chars"))).alias("all"),
        F.collect_list(F.when((F.col("kind") >= ELEMENT), F.struct("kind", "depth", "token", "chars"))).alias("elements"),
        F.collect_list(F.when((F.col("kind") != RUN) & (F.col("token") != 0), F.col("token"))).alias("tags"),
        F.collect_list(F.when(F.col("kind") == RUN, F.col("token"))).alias("runs"),
    )
    most = F.filter("elements", lambda e: (e["chars"] >= MOST_TEXT * F.col("all")) & (F.col("all") > 0))
    return listed.select("host", F.array_max(most)["token"].alias("main"), "tags", "runs")


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    found = staged(templates(pages), "templates")
    every = found.where(F.col("host") == EVERY_HOST).collect()
    general = (set(every[0]["tags"]), set(), every[0]["main"]) if every else (set(), set(), None)
    chosen = with_templates(pages, found, "main", "tags", "runs")
    with_template = chosen.select("page_id", "url", "html", "own", "main", "tags", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = (batch.column(i).to_pylist() for i in range(2, 7))
            texts = [
                main_text(html, *((set(tags), set(runs), main) if own else general))
                for html, own, main, tags, runs in zip(*columns)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array(map(len, texts), pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    return with_template.mapInArrow(run, "page_id long, url string, text string, n_chars long")
