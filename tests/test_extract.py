"""Extraction from the hand-written corpus."""

from __future__ import annotations

import random
import re
from decimal import Decimal

import pytest

from pyspark.sql import functions as F

from folioscan.functions.columns import running
from folioscan.operators import audit, extract, links, markup
from folioscan.sources import in_part, read_docs, read_written, write_docs


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def of(df, doc, *columns):
    return rows(df.where(df.doc_id == doc), *columns)


def test_one_file_is_one_row(mails):
    assert sorted(r.doc_id for r in mails.collect()) == ["bare", "base", "empty", "same_text", "variant"]


def test_file_names_may_hold_anything(spark, tmp_path):
    (tmp_path / "a+b 50%.html").write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "ñ.htm").write_text("y")
    docs = read_docs(spark, str(tmp_path))
    assert rows(docs, "doc_id", "html") == [("a+b 50%", "x"), ("sub/ñ", "y")]


def test_files_of_one_name_stay_apart(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "index.html").write_text(folder)
    assert rows(read_docs(spark, str(tmp_path)), "doc_id", "html") == [("a/index", "a"), ("b/index", "b")]


def test_ids_begin_below_the_given_folder(spark, tmp_path, monkeypatch):
    root = tmp_path / "mails" / "x" / "mails"
    (root / "mails").mkdir(parents=True)
    (root / "mails" / "a.html").write_text("a")
    for path in (str(root), f"file:{root}/", f"file://{root}"):
        assert rows(read_docs(spark, path), "doc_id", "html") == [("mails/a", "a")]


def test_written_by_language_and_read_back(spark, mails, tmp_path):
    langs = [("1", "x", "01"), ("2", "y", "1"), ("3", "", ""), ("4", "z", "es"), ("5", "w", None)]
    docs = spark.createDataFrame(langs, "doc_id string, html string, lang string")
    for i, rebalance in enumerate((False, True)):
        path = str(tmp_path / str(i))
        write_docs(docs, path, rebalance=rebalance)
        back = read_written(spark, path, docs.schema)
        assert sorted(back.collect(), key=str) == sorted(docs.collect(), key=str)
        found = spark.read.parquet(path).where(in_part("lang", "01"))
        assert [r.doc_id for r in found.collect()] == ["1"]
        assert "PartitionFilters: [isnotnull(part_lang" in found._jdf.queryExecution().toString()


def test_markup_leaves_out_comments_scripts_and_styles(spark):
    html = (
        "<!-- <a href='/old'>x</a><img src='/old'> --><script>var t=\"</p><a href='/s'>\";</script>"
        "<style>p{}</style><p><p><a href='/new'>Antes</a><img alt src=/i.png><div style='display:none'>Hola</div>"
        "<p style='font-family:Arial'>Hola</p><p style=\"font-family:'A B',c\">"
    )
    docs = spark.createDataFrame([(1, html)], "doc_id long, html string")
    assert rows(extract.links(docs), "pos", "href") == [(0, "/new")]
    assert rows(extract.link_texts(docs), "pos", "href", "text") == [(0, "/new", "Antes")]
    assert rows(extract.images(docs), "pos", "src", "alt") == [(0, "/i.png", None)]
    assert rows(markup.nesting_depth(docs, "p"), "max_depth") == [(3,)]
    tags = dict(rows(markup.doc_tags(docs), "tag", "n"))
    assert tags == {"a": 1, "div": 1, "img": 1, "p": 4, "script": 1, "style": 1}
    assert rows(extract.preheader(docs), "preheader") == [("Hola",)]
    assert rows(markup.font_stacks(docs), "font_stack") == [("'A B',c",), ("Arial",)]
    (checks,) = audit.audit(docs).collect()
    assert checks.has_preheader and checks.images_have_alt
    (bad,) = audit.audit(docs.withColumn("html", F.lit("<img title=' alt ' src=x>"))).collect()
    assert not bad.images_have_alt


def test_metadata(mails):
    meta = extract.doc_metadata(mails)
    assert of(meta, "base", "title", "lang") == [("Ven a vernos", "es")]
    assert of(meta, "bare", "title", "lang") == [("", "en")]
    assert of(meta, "empty", "title", "lang") == [("", "")]


def test_preheader_and_comment_header(mails):
    assert of(extract.preheader(mails), "base", "preheader") == [("Abrimos el lunes",)]
    assert of(extract.preheader(mails), "bare", "preheader") == [("",)]
    header = extract.comment_header(mails)
    assert of(header, "base", "subject", "preheader") == [("Ven a vernos", "Abrimos el lunes")]
    assert of(header, "empty", "subject", "preheader") == [("", "")]


def test_links_agree_with_and_without_text(mails):
    plain = rows(extract.links(mails), "doc_id", "pos", "href")
    texts = extract.link_texts(mails)
    assert plain == rows(texts, "doc_id", "pos", "href")
    assert of(texts, "base", "pos", "text")[:3] == [(0, "Entrar"), (1, "Antes"), (2, "Después")]


def test_kinds_of_links(mails):
    kinds = links.classify_links(extract.links(mails))
    found = of(kinds, "base", "pos", "kind", "scheme", "host")
    assert found[0] == (0, "web", "https", "www.example.org")
    assert [k for _, k, _, _ in found] == ["web"] * 6 + ["relative", "web"] + ["mailto"] * 2 + [
        "tel",
        "placeholder",
    ]


def test_mail_subjects_keep_plus_and_drop_bad_escapes(mails):
    subjects = links.mailto_subjects(extract.links(mails))
    assert of(subjects, "base", "subject") == [("Quiero más+info",)]
    assert of(subjects, "bare", "subject") == [(None,)]


def test_domains_and_shared_images(mails):
    domains = rows(links.link_domains(mails), "host", "n_links", "n_docs")
    assert domains == [("files.example.net", 18, 3), ("www.example.org", 3, 3)]
    assert rows(links.shared_images(mails), "url", "n_docs") == [("https://img.example.org/logo.png", 3)]
    assert ("/otro", 3) in rows(links.shared_links(mails), "url", "n_docs")


def test_images_tell_missing_attributes(mails):
    images = extract.images(mails)
    assert of(images, "base", "src", "alt", "width") == [("https://img.example.org/logo.png", "Logo", "160")]
    assert of(images, "bare", "src", "alt", "width") == [("x.png", None, None)]


def test_pairs_are_neighbours(mails):
    pairs = links.paired_links(mails)
    files = "https://files.example.net/"
    assert of(pairs, "base", "pair", "before_href", "after_href") == [
        (0, files + "a-1.pdf", files + "b-1.pdf"),
        (1, files + "a-2.pdf", files + "b-2.pdf"),
    ]


def test_visible_text(mails):
    (text,) = of(extract.visible_text(mails), "base", "text")[0]
    assert text.startswith("Abrimos el lunes Hola Primera &amp; segunda &nbsp;l&iacute;nea. &#123456; Entrar")
    assert "<" not in text and "fake" not in text and "vernos" not in text
    stats = extract.text_stats(mails)
    assert of(stats, "base", "n_words", "n_chars") == [(len(text.split(" ")), len(text))]
    assert of(stats, "empty", "n_words", "n_chars") == [(0, 0)]


def test_stats_by_language(mails):
    stats = {r.lang: r for r in extract.stats_by_language(mails).collect()}
    assert stats["en"].n_docs == 1 and stats["en"].max_words == 6
    assert stats["es"].n_docs == 3 and stats[""].avg_words == 0


def test_sections_and_merge_tags(mails):
    assert of(extract.sections(mails), "base", "pos", "name") == [(0, "Avance"), (1, "Cabecera")]
    assert of(extract.merge_tags(mails), "base", "tag", "n") == [("unsubscribe_url", 1)]
    assert of(extract.merge_tags(mails), "bare", "tag", "n") == [("first_name", 1)]


def test_prices(mails):
    amounts = [a for _, a in of(extract.prices(mails), "base", "pos", "amount")]
    assert amounts == [Decimal("250.00"), Decimal("6.25"), Decimal("80.00"), Decimal("1250.50")]
    assert of(extract.prices(mails), "bare", "amount") == []
    packs = of(extract.pack_prices(mails), "base", "pos", "units", "stated", "computed", "agrees")
    assert packs == [
        (0, 40, Decimal("6.25"), Decimal("6.25"), True),
        (1, 10, None, Decimal("8.00"), None),
    ]


def test_tags_and_depth(mails):
    histogram = {r.tag: (r.n, r.n_docs) for r in markup.tag_histogram(mails).collect()}
    assert histogram["table"] == (13, 4) and histogram["img"] == (4, 4)
    depth = dict(rows(markup.nesting_depth(mails, "table"), "doc_id", "max_depth"))
    assert depth == {"base": 4, "same_text": 4, "variant": 4, "bare": 1, "empty": 0}
    # "b" must not count "body", nor "p" the "pre"-like names.
    assert dict(rows(markup.nesting_depth(mails, "b"), "doc_id", "max_depth"))["bare"] == 0


def test_colours_skip_character_references(mails):
    palette = markup.palette(mails)
    assert of(palette, "base", "colour", "n") == [("#102030", 2), ("#fafafa", 2)]
    top = markup.top_colours(mails, 1)
    assert of(top, "base", "colour", "n", "rank") == [("#102030", 2, 1)]
    tags = markup.top_tags(mails, 2)
    assert of(tags, "base", "rank", "tag", "n") == [(1, "a", 13), (2, "table", 4)]


def test_fonts_and_classes(mails):
    assert rows(markup.font_stacks(mails), "font_stack", "n_docs") == [("'Gill Sans', Arial", 3)]
    assert of(markup.unused_classes(mails), "base", "class") == [("unused",)]
    assert of(markup.duplicate_rules(mails), "base", "class", "n") == [("big", 2)]


def test_audit(mails):
    checks = audit.audit(mails)
    assert of(checks, "base", *audit.RULES) == [(True, True, True, True, True)]
    assert of(checks, "bare", *audit.RULES) == [(False, True, False, False, False)]
    assert of(checks, "empty", *audit.RULES) == [(False, False, False, False, True)]
    (summary,) = audit.audit_summary(checks).collect()
    assert summary.n_docs == 5 and summary.fail_has_title == 2 and summary.fail_images_have_alt == 1


def test_metadata_drift(mails):
    assert rows(audit.metadata_drift(mails), "doc_id", "subject", "title") == [
        ("same_text", "Ven a vernos", "Otra")
    ]


def test_text_with_angle_brackets_and_long_runs(spark):
    html = "<p>2 < 3 > 1</p>" + "<" * 20000 + "7" + " " * 20000 + "5 €" + "1" * 20000
    docs = spark.createDataFrame([(1, html)], "doc_id long, html string")
    (text,) = extract.visible_text(docs).collect()
    assert text.text == "2 < 3 > 1 " + "<" * 20000 + "7 5 €" + "1" * 20000
    (price,) = extract.prices(docs).collect()
    assert price.amount == Decimal("5.00")


def test_comments_and_scripts_say_nothing(spark):
    html = (
        "<!-- <html lang='xx'><title>old</title><div style='display:none'>no</div> 99 € #aabbcc --><html lang=es>"
        "<script>var a = '7 € {{unsubscribe_url}} <title>x</title> #ddeeff';</script><title>new</title>"
        "<style>.a{color:#010203}</style><p>5 €</p>"
    )
    docs = spark.createDataFrame([(1, html)], "doc_id long, html string")
    assert rows(extract.doc_metadata(docs), "title", "lang") == [("new", "es")]
    assert rows(extract.prices(docs), "amount") == [(Decimal("5.00"),)]
    assert rows(extract.preheader(docs), "preheader") == [("",)]
    assert rows(markup.palette(docs), "colour", "n") == [("#010203", 1)]
    assert rows(extract.stats_by_language(docs), "lang") == [("es",)]
    (checks,) = audit.audit(docs).collect()
    assert checks.has_title and not checks.has_unsubscribe and not checks.has_preheader
    only = docs.withColumn("html", F.lit("<!-- <html lang='es'><title>no</title> --><html lang=''>"))
    (checks,) = audit.audit(only).collect()
    assert not checks.has_title and not checks.has_lang


def elements_by_stack(html):
    """``first, last, depth`` of every div, with a stack."""
    stack, found = [], []
    for mark in re.finditer(r"(?i)<(/?)div(?:[\s/][^>]*)?>", html):
        if not mark[1]:
            found.append([mark.start(), len(html), len(stack) + 1])
            stack.append(found[-1])
        elif stack:
            stack.pop()[1] = mark.end()
    return [tuple(element) for element in found]


def test_extent_of_elements(spark):
    draw = random.Random(2)
    parts = ["<div>", "<div class='x'>", "</div>", "</DIV >", "a", "bb", "<p>", "<divx>", "\n", "é"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.choice([0, 1, 3, 10, 30, 700]))) for _ in range(150)]
    texts += ["<div>" * 600 + "x" + "</div>" * 599, "</div></div><div>", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, html string").repartition(4)
    got = rows(extract.elements(docs, "div"), "doc_id", "pos", "first", "last", "depth")
    want = [(i, pos, *element) for i, t in enumerate(texts) for pos, element in enumerate(elements_by_stack(t or ""))]
    assert got == sorted(want)


@pytest.mark.parametrize(
    "html, text",
    [
        ("<div style='display:none'>one <div>two <div>three</div></div> four</div><p>no</p>", "one two three four"),
        ("<div><div style=\"color:red; display : none\">in <b>side</b></div>out</div>", "in side"),
        ("<div style='display:none'>to the <div>end</div>", "to the end"),
        ("</div><div style='display:none'>after a stray mark</div>", "after a stray mark"),
        ("<p style='display:none'>not a div</p>", ""),
    ],
)
def test_the_whole_hidden_block(spark, html, text):
    docs = spark.createDataFrame([(1, html)], "doc_id long, html string")
    assert rows(extract.preheader(docs), "preheader") == [(text,)]


def test_running_sums_over_several_blocks(spark):
    draw = random.Random(6)
    lists = [[draw.choice([-1, 1, 1, 3]) for _ in range(n)] for n in (0, 1, 2, 3, 4, 7, 50)]
    numbers = spark.createDataFrame(list(enumerate(lists)), "i long, xs array<long>")
    for i, found in numbers.select("i", running(F.col("xs"), 3)).collect():
        total, low, want = 0, 0, []
        for x in lists[i]:
            total, low = total + x, min(low, total + x)
            want.append((total, low))
        assert [tuple(x) for x in found] == want
