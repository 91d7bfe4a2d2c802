"""Files as a data source, corpora in parts, counts that can be added up, aligned differences."""

from __future__ import annotations

import bisect
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from folioscan.operators import diff, links, markup, sketches
from folioscan.sources import html_files
from folioscan.sources.html_files import read_files, write_files
from folioscan.sources.parts import changes, read_parts, update_docs
from tests.mails import MAILS
from tests.test_versions import frame


def rows(df):
    return sorted(map(tuple, df.collect()))


# Files.


def test_mails_written_and_read(spark, tmp_path):
    mails = MAILS | {"empty": "", "sub/ñ a+b 50%": "<p>é</p>"}
    docs = spark.createDataFrame(list(mails.items()), "doc_id string, html string")
    write_files(docs, str(tmp_path))
    assert (tmp_path / "empty.html").stat().st_size == 0
    want = sorted((name, html, len(html.encode())) for name, html in mails.items())
    for path in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        assert rows(read_files(spark, path)) == want
    # Written again, the files are the same.
    write_files(docs, str(tmp_path))
    assert rows(read_files(spark, str(tmp_path))) == want


def test_ids_do_not_depend_on_the_name_of_the_folder(spark, tmp_path):
    root = tmp_path / "mails" / "mails"
    (root / "mails").mkdir(parents=True)
    (root / "mails" / "x.htm").write_bytes(b"\xff<p>")
    (root / "notes.txt").write_text("no")
    (root / "_writing-1.html").write_text("no")
    assert rows(read_files(spark, str(root))) == [("mails/x", "�<p>", 4)]
    assert [r.doc_id for r in read_files(spark, str(root), glob="*.txt").collect()] == ["notes.txt"]


def test_many_files_are_few_partitions(spark, tmp_path):
    for i in range(10_000):
        (tmp_path / f"{i}.html").write_text("" if i % 10 == 0 else "x")
    docs = read_files(spark, str(tmp_path))
    assert docs._jdf.queryExecution().toRdd().getNumPartitions() == -(-10_000 * (html_files.OPENING + 1) // html_files.PACKED)
    assert docs.count() == 10_000 and docs.where("n_bytes = 0").count() == 1000


def test_packs_hold_all_files_in_order():
    sizes = [5, 5, 100, 0, 0, 7]
    assert list(html_files.packed(sizes, 12, 1)) == [(0, 2), (2, 3), (3, 6)]
    assert list(html_files.packed(sizes, 1, 1)) == [(i, i + 1) for i in range(6)]
    assert list(html_files.packed([], 12, 1)) == []


def test_an_empty_folder_and_names_that_no_file_can_have(spark, tmp_path):
    assert read_files(spark, str(tmp_path)).collect() == []
    for name in ("../up", "/root", None):
        with pytest.raises(PySparkException):
            write_files(spark.createDataFrame([(name, "x")], "doc_id string, html string"), str(tmp_path))


# Parts.

DOCS = "doc_id long, lang string, html string"


def stored_files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_only_changed_parts_are_written(spark, tmp_path):
    path = tmp_path / "corpus"
    given = [(i, lang, f"text {i}") for i, lang in enumerate(["es", "en", "de", None, ""] * 20)]
    docs = spark.createDataFrame(given, DOCS)
    assert {r.state for r in update_docs(docs, str(path), slices=3).collect()} == {"new"}
    first = stored_files(path)
    again = update_docs(docs.orderBy(F.desc("doc_id")), str(path), slices=3)
    assert {r.state for r in again.collect()} == {"same"}
    assert stored_files(path) == first

    changed = docs.where("lang IS NULL OR lang <> 'de'").withColumn(
        "html", F.when(F.col("doc_id") == 6, "other").otherwise(F.col("html"))
    )
    states = rows(update_docs(changed, str(path), slices=3).select("part_lang", "state"))
    assert states.count((":en", "changed")) == 1 and states.count((":de", "gone")) == 3
    assert {state for _, state in states} == {"same", "changed", "gone"}
    then = stored_files(path)
    kept = {name for name in first if name in then}
    assert all(first[name] == then[name] for name in kept)
    assert {name.split("/")[0] for name in set(first) - kept} == {"part_lang=%3Ade", "part_lang=%3Aen"}
    back = read_parts(spark, str(path), docs.schema)
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, changed.collect()))


def test_reads_of_a_part_are_pruned(spark, tmp_path):
    path = str(tmp_path / "corpus")
    docs = spark.createDataFrame([(1, "es", "a"), (2, "en", "b")], DOCS)
    update_docs(docs, path)
    found = read_parts(spark, path, docs.schema).where(F.col("part_lang") == ":es")
    assert [r.html for r in found.collect()] == ["a"]
    assert "PartitionFilters: [isnotnull(part_lang" in found._jdf.queryExecution().toString()
    sums = changes(docs, path)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<digest_one:bigint,digest_two:bigint>" in sums


@pytest.mark.parametrize(
    "before, after",
    [
        ([(1, "es", None)], [(1, None, "es")]),
        ([(1, "es", "a"), (1, "es", "a")], [(1, "es", "a")]),
        ([(1, "es", "a"), (2, "es", "b")], [(1, "es", "b"), (2, "es", "a")]),
        ([(1, "es", "a"), (1, "es", "a")], [(1, "es", "b"), (1, "es", "b")]),
        ([(1, "es", "a")], [(1, "es", "")]),
        ([(1, "es", None)], [(1, "es", "")]),
        ([], [(1, "es", "a")]),
        ([(1, "es", "a")], []),
    ],
)
def test_every_change_is_seen(spark, tmp_path, before, after):
    path = str(tmp_path / "corpus")
    update_docs(spark.createDataFrame([*before, (9, "xx", "stays")], DOCS), path)
    docs = spark.createDataFrame([*after, (9, "xx", "stays")], DOCS)
    update_docs(docs, path)
    back = read_parts(spark, path, docs.schema).select(*docs.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))


# Sketches.


def test_sketches_of_deliveries_add_up(spark):
    html = F.concat(
        F.lit("<a href='http://all.example/'></a><a href='http://h"), F.col("id") % 7, F.lit(".example/x'></a><p>")
    )
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), html.alias("html"))
    parts = [docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 <> 1")]
    united = sketches.united(*(sketches.domain_sketches(part) for part in parts))
    found = {r["value"]: r for r in sketches.estimated(united).collect()}
    for r in links.link_domains(docs).collect():
        assert abs(found[r["host"]]["n_docs"] - r["n_docs"]) <= 0.05 * r["n_docs"]
    assert found["all.example"]["n"] == sum(part.count() for part in parts)
    both = {r["value"]: r for r in sketches.overlap(*(sketches.domain_sketches(part) for part in parts)).collect()}
    shared = docs.where("doc_id % 3 = 2").count()
    assert abs(both["all.example"]["n_both"] - shared) < 0.15 * shared


def test_sketches_of_few_documents_are_exact(mails):
    tags = {r["value"]: (r["n"], r["n_docs"]) for r in sketches.estimated(sketches.tag_sketches(mails)).collect()}
    assert tags == {r["tag"]: (r["n"], r["n_docs"]) for r in markup.tag_histogram(mails).collect()}
    shared = sketches.estimated(sketches.link_sketches(mails), 2)
    assert sorted((r["value"], r["n_docs"]) for r in shared.collect()) == rows(links.shared_links(mails))
    images = sketches.estimated(sketches.image_sketches(mails), 2)
    assert sorted((r["value"], r["n_docs"]) for r in images.collect()) == rows(links.shared_images(mails))


# Aligned differences.


def longest_rise(values):
    ends = []
    for value in values:
        at = bisect.bisect_left(ends, value)
        ends[at : at + 1] = [value]
    return len(ends)


def test_what_is_left_is_the_same_on_both_sides(spark):
    draw = random.Random(1)
    texts = []
    for _ in range(60):
        a = [draw.choice("abcdefghijklmnopqrstuvwxyz") * draw.choice([1, 1, 2]) for _ in range(draw.choice([0, 1, 3, 8, 30]))]
        b = list(a)
        for _ in range(draw.randint(0, 6)):
            kind = draw.random()
            if kind < 0.4:
                b.insert(draw.randint(0, len(b)), draw.choice(["new", "x", "a", "y9"]))
            elif b and kind < 0.7:
                b.pop(draw.randrange(len(b)))
            elif len(b) > 2:
                i = draw.randrange(len(b) - 1)
                b[i], b[i + 1] = b[i + 1], b[i]
        texts += ["\n".join(a), "\n".join(b)]
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(60)], "a long, b long")
    found = {}
    for r in diff.aligned_diffs(frame(spark, texts), pairs).collect():
        found.setdefault((r["a"], r["side"]), {})[r["line"]] = r["text"]
    for i in range(60):
        a, b = texts[2 * i].split("\n"), texts[2 * i + 1].split("\n")
        gone, new = found.get((2 * i, "a"), {}), found.get((2 * i, "b"), {})
        assert all(a[line] == text for line, text in gone.items()) and all(b[line] == text for line, text in new.items())
        kept = [text for line, text in enumerate(a) if line not in gone]
        assert kept == [text for line, text in enumerate(b) if line not in new]
        once = [b.index(text) for text in a if a.count(text) == b.count(text) == 1]
        assert len(kept) >= longest_rise(once)


def test_one_line_put_in_is_one_row(spark):
    lines = [f"line {i}" for i in range(500)] + ["same"] * 20
    texts = frame(spark, ["\n".join(lines), "\n".join([*lines[:77], "new", *lines[77:]]), "\n".join(lines[:9] + lines[10:])])
    assert rows(diff.aligned_diff(texts, 0, 1)) == [("b", 77, "new")]
    assert rows(diff.aligned_diff(texts, 1, 0)) == [("a", 77, "new")]
    assert rows(diff.aligned_diff(texts, 0, 2)) == [("a", 9, "line 9")]
    assert diff.aligned_diff(texts, 0, 0).collect() == []
    assert diff.revision_diff(texts, 0, 1).count() > 800


def test_moved_repeated_and_missing(spark):
    texts = frame(spark, ["a\nb\nc\nd", "b\nc\nd\na", "x\nx\nx", "x\nx", ""])
    assert rows(diff.aligned_diff(texts, 0, 1)) == [("a", 0, "a"), ("b", 3, "a")]
    assert rows(diff.aligned_diff(texts, 2, 3)) == [("a", 2, "x")]
    assert rows(diff.aligned_diff(texts, 3, 4)) == [("a", 0, "x"), ("a", 1, "x"), ("b", 0, "")]
    assert rows(diff.aligned_diff(texts, 3, 9)) == [("a", 0, "x"), ("a", 1, "x")]
    assert rows(diff.aligned_diff(texts, 9, 3)) == [("b", 0, "x"), ("b", 1, "x")]
