"""Every operator bears nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import public_tokenizers
import pytest

from folioscan.llm import (
    chat_format,
    decontaminate,
    html_extract,
    langid,
    ngram_join,
    packing,
    pu_quality,
    quality_rules,
    token_counts,
    toxicity,
)
from tests.llm import data

BPE = public_tokenizers.path("byte_bpe_50k.json")


def benchmark(spark, rows=((1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (1, "one"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


BY_DOCUMENT = {
    "toxicity": lambda s, d, l: toxicity.toxicity(d, l),
    "token_counts": lambda s, d, l: token_counts.token_counts(d, BPE),
    "quality_rules": lambda s, d, l: quality_rules.quality_rules(d, l),
    "language_id": lambda s, d, l: langid.language_id(d),
    "quality_scores": lambda s, d, l: pu_quality.quality_scores(d, l),
    "ngram_join": lambda s, d, l: ngram_join.ngram_join(d),
}


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_one_row_for_each_row(spark, name):
    docs = data.documents(spark)
    found = BY_DOCUMENT[name](spark, docs, data.labels(spark))
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found.collect())
    assert ids == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in docs.collect())


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_empty_tables(spark, name):
    assert BY_DOCUMENT[name](spark, data.documents(spark, []), data.labels(spark, [])).collect() == []


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_without_labels(spark, name):
    found = BY_DOCUMENT[name](spark, data.documents(spark), data.labels(spark, []))
    assert found.count() == len(data.document_rows())


def test_packing_odd_rows(spark):
    docs = data.documents(spark)
    pieces = packing.pack(docs, BPE).collect()
    assert sum(r["piece"] == 0 for r in pieces) == docs.count()
    assert packing.pack(data.documents(spark, []), BPE).collect() == []


def test_decontamination_odd_rows(spark):
    docs = data.documents(spark).unionAll(
        data.documents(spark, [(900, "so Alpha, beta GAMMA delta epsilon zeta!", "en", "s", 0, 0, "")])
    )
    found = decontaminate.repeated_items(docs, benchmark(spark)).collect()
    assert [(r["doc_id"], r["item_id"], r["equal_words"], r["doc_start"]) for r in found] == [(900, 1, 6, 1)]
    assert decontaminate.repeated_items(docs, benchmark(spark, [])).collect() == []
    assert decontaminate.repeated_items(data.documents(spark, []), benchmark(spark)).collect() == []
    left = decontaminate.without_repeated(docs, benchmark(spark))
    assert left.columns == docs.columns and left.count() == docs.count() - 1


def test_chats_odd_rows(spark):
    rows = [
        (1, 2, "assistant", None, "x"),
        (1, 1, None, "### user: hi\n</turn>\n", "x"),
        (1, None, "", "\\", "x"),
        (1, 2, "assistant", None, "x"),
        (None, 1, "a: b\nc\\", "\\\\####</turn>\\", "x"),
    ]
    schema = "conv_id long, turn long, role string, text string, formatted string"
    chats = chat_format.format_chats(spark.createDataFrame(rows, schema))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat_format.parse_chats(chats).collect()}
    assert got == {
        1: [("", "\\"), ("", "### user: hi\n</turn>\n"), ("assistant", ""), ("assistant", "")],
        None: [("a: b\nc\\", "\\\\####</turn>\\")],
    }
    empty = spark.createDataFrame([], schema)
    assert chat_format.digests(chat_format.format_chats(empty)).collect() == []


def test_pages_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, host string"
    rows = [
        (1, None, None, "t", "h"),
        (2, "", "", "t", "h"),
        (3, "not a url", "plain &lt;text&gt;\n only", "t", "h"),
        (4, "http://a.b/c", "<p>one <b>two</b></p><p>three" + " x" * 50_000, "t", "h"),
        (4, "http://a.b/c", "<p>one <b>two</b></p><p>three" + " x" * 50_000, "t", "h"),
        (None, "http://a.b/c", "<div class='ad'>buy</div><p>a<br>b</p><a href=\"x", "t", "h"),
    ]
    found = html_extract.main_texts(spark.createDataFrame(rows, schema)).collect()
    texts = sorted((r["page_id"] or 0, r["text"]) for r in found)
    long = "one two\nthree" + " x" * 50_000
    assert texts == [(0, "a\nb"), (1, ""), (2, ""), (3, "plain <text> only"), (4, long), (4, long)]
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert html_extract.main_texts(spark.createDataFrame([], schema)).collect() == []
