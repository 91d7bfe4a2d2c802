"""What the work of a query grows with: folders, shuffled rows, stored rows, memory."""

from __future__ import annotations

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from folioscan.operators import dedup, families, minhash
from folioscan.plans import letters, texts
from folioscan.session import scratch_path
from folioscan.sources import files
from tests.test_versions import frame


def test_letters_are_read_from_a_bounded_number_of_folders(spark, tmp_path, monkeypatch):
    """A folder a letter would be made, moved and listed one by one in the driver."""
    monkeypatch.setattr(letters, "scratch_path", lambda spark, name: str(tmp_path / name))
    found = letters.files(spark, "/root/testdata/sf0.01")
    folders = [folder for folder, _, _ in os.walk(tmp_path)]
    assert found.select("doc_id").distinct().count() == found.count() == 1000
    assert len(folders) <= letters.FOLDERS + 2


def test_a_large_tree_is_read_by_folders(spark, tmp_path, monkeypatch):
    """The same rows as in one piece, and no more files known to the driver at once than are asked for."""
    names = [f"{folder}/{i}" for folder in ("a", "b b", "c[1]", "d/e", "d/f+%", "d/ñ{x}", "_k=1") for i in range(3)]
    names += ["top", "other", "d/direct", "_hidden/1", ".hidden/1", "d/_hidden/2", "_top", "flat/" + "x" * 9]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"{name}.html").write_text(name)
    (tmp_path / "d" / "note.txt").write_text("no document")
    whole = sorted(map(tuple, files.read_docs(spark, str(tmp_path)).collect()))
    assert [row[0] for row in whole] == sorted(name for name in names if "hidden" not in name and name != "_top")
    known, docs = [], files._docs
    monkeypatch.setattr(files, "_docs", lambda *a: (lambda df: known.append(len(df.inputFiles())) or df)(docs(*a)))
    before = {key: spark.conf.get(key) for key in files.BY_FOLDERS}
    for path in (str(tmp_path), f"file://{tmp_path}/"):
        known.clear()
        assert sorted(map(tuple, files.read_docs(spark, path, most=4).collect())) == whole
        assert len(known) > 5 and max(known) <= 4 and sum(known) == len(whole)
    assert {key: spark.conf.get(key) for key in files.BY_FOLDERS} == before


def kept_sets(spark, monkeypatch, search, texts):
    """How many documents a search orders the shingles of, and its result."""
    sizes = []
    items = dedup._items
    monkeypatch.setattr(dedup, "_items", lambda sets: sizes.append(sets.count()) or items(sets))
    return sum(sorted(map(tuple, search(frame(spark, texts)).collect())), ()), sizes


@pytest.mark.parametrize("search", [dedup.near_duplicates, dedup.version_family])
def test_documents_without_company_are_not_ordered(spark, monkeypatch, search):
    """Unlike documents, some of which share a passage or are copies, and one pair of near copies."""
    draw = random.Random(4)
    texts = [" ".join(f"w{draw.randrange(5000)}" for _ in range(80)) for _ in range(60)]
    passage = " ".join(texts[0].split()[:12])
    texts += [passage + " " + " ".join(f"x{i}x{j}" for j in range(60)) for i in range(20)]
    texts += [texts[5] + " one more", texts[6].upper()]
    got, sizes = kept_sets(spark, monkeypatch, search, texts)
    if search is dedup.near_duplicates:
        assert got[:2] + got[3:] == (5, 80, 6, 81, 1.0)
    else:
        assert got == (5, 5, 6, 6, 80, 5, 81, 6)
    assert sizes == [2]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_partners_share_enough_keys(spark, threshold):
    """Sets of any two sizes that are as similar as the threshold asks for, and no more."""
    draw = random.Random(7)
    pairs = []
    for _ in range(150):
        small = draw.randrange(1, 60)
        large = draw.randrange(small, int(small / threshold) + 1)
        common = math.ceil(threshold / (1 + threshold) * (small + large) - 1e-9)
        values = [draw.getrandbits(63) - (1 << 62) for _ in range(small + large)]
        pairs.append((values[:small], values[small - common : small + large - common]))
    rows = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    (keys_a, least_a), (keys_b, least_b) = (
        dedup.prefix_keys(F.col(c), F.size(c), threshold) for c in ("a", "b")
    )
    shared = F.size(F.array_intersect(keys_a, keys_b))
    jaccard = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    found = rows.select(jaccard.alias("jaccard"), shared.alias("shared"), F.greatest(least_a, least_b).alias("least"))
    found = found.where(F.col("jaccard") >= threshold).collect()
    assert len(found) == 150 and all(row["shared"] >= row["least"] for row in found)


def test_a_delivery_orders_only_what_may_be_similar(spark, monkeypatch):
    """Of the earlier documents one is like a new one; a family that is known is not compared again."""
    draw = random.Random(8)
    texts = [" ".join(f"w{draw.randrange(5000)}" for _ in range(60)) for _ in range(40)]
    texts += [texts[3] + " one", texts[7] + " two", texts[3] + " three", texts[39] + " four"]
    docs = frame(spark, texts)
    path = scratch_path(spark, "families")
    sizes, compared = [], []
    items, compare = dedup._items, dedup._compared
    monkeypatch.setattr(dedup, "_items", lambda sets: sizes.append(sets.count()) or items(sets))
    monkeypatch.setattr(dedup, "_compared", lambda p, s: compared.append(p.count()) or compare(p, s))
    families.start(docs.where("doc_id < 41"), path)
    assert sizes == [2]
    compared.clear()
    got = families.add(docs.where("doc_id > 40"), path, 1)
    found = sorted(map(tuple, got.select("doc_id", "family").collect()))
    assert found == [(3, 3), (7, 7), (39, 39), (40, 3), (41, 7), (42, 3), (43, 39)]
    assert sizes == [2, 7] and sum(compared) <= 5
    with pytest.raises(ValueError):
        families.add(docs.where("doc_id > 40"), path, 1)


def test_bands_carry_no_slots(spark, monkeypatch):
    """What is shuffled for each band is a key and ids; sets are made of documents that meet."""
    written = {}
    stage = minhash.staged
    monkeypatch.setattr(minhash, "staged", lambda df, name: written.setdefault(name, []).append(stage(df, name)) or written[name][-1])
    draw = random.Random(9)
    texts = [" ".join(f"w{draw.randrange(5000)}" for _ in range(90)) for _ in range(30)]
    texts += [texts[2] + " one"]
    assert [tuple(r)[:2] for r in minhash.minhash_duplicates(frame(spark, texts)).collect()] == [(2, 30)]
    assert all("further" not in bands.columns for bands in written["bands"])
    assert [sets.count() for sets in written["sets"]] == [2]


def test_recall_takes_what_both_tiers_need_from_one_pass(spark, sf_dir, monkeypatch):
    """Texts are summed up once, and not shuffled for their signatures however many there are."""
    plans = {}
    stage = minhash.staged

    def noted(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)

    for module in (dedup, minhash):
        monkeypatch.setattr(module, "staged", noted)
    monkeypatch.setattr(dedup, "BROADCAST_IDS", 0)
    want = dedup.near_duplicates(texts.texts(spark, sf_dir)).count()
    plans.clear()
    found = texts.minhash_recall(spark, sf_dir).first()
    assert found["n_exact"] == want > 0
    assert len(plans["members"]) == len(plans["signatures"]) == 1 and "hashed" not in plans
    assert "Exchange" not in plans["signatures"][0]


def test_further_rounds_carry_only_what_is_left(spark, monkeypatch):
    """A large bucket of unlike documents is split; documents of other buckets have been compared."""
    draw = random.Random(11)
    entries = [(1, i, 1) for i in range(12)] + [(2, i, 1) for i in range(12, 14)]
    sets = [(i, 80, [draw.getrandbits(62) for _ in range(80)]) for i in range(14)]
    further = [(i, 1, [draw.getrandbits(62) for _ in range(minhash.FURTHER)]) for i in range(14)]
    kept = minhash._kept(spark.createDataFrame(entries, "key long, doc_id long, kind int"))
    bands = spark.createDataFrame(further, "doc_id long, kind int, further array<long>")
    tables = spark.createDataFrame(sets, "doc_id long, n int, shingles array<long>")
    sizes = []
    similar = minhash._similar
    monkeypatch.setattr(minhash, "_similar", lambda p, s, t: sizes.append(s.count()) or similar(p, s, t))
    assert minhash.candidates(kept, bands, tables, 0.5, bucket_rows=5).count() == 0
    assert sizes[0] == 14 and sizes[1:] and max(sizes[1:]) <= 11


def test_equal_words_have_one_first_document(spark):
    """Case and spacing tell no texts apart; other words, and other borders of words, do."""
    found = ["A\tb  c d E", "\n a b c\x0b d e ", "ab c d e f", "a bc d e f", None, "", "A B C D e"]
    heads = dedup._members(frame(spark, found), 5)
    assert sorted((r["doc_id"], r["head"]) for r in heads.collect()) == [(0, 0), (1, 0), (2, 2), (3, 3), (6, 0)]
    marks = {r["doc_id"]: r["mark"] for r in heads.collect()}
    assert marks[0] == marks[1] == marks[6] and len(set(marks.values())) == 3
