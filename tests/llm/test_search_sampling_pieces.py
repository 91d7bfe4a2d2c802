"""Hard negatives, importance resampling and sentencepiece against brute force and the library."""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from folioscan.llm import hard_negatives, resampling, sentence_pieces
from tests.llm import data
from tests.oracle import connect

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


# Hard negatives.

EMBEDDINGS = "vec_id long, embedding array<float>, label int, score long, cell int"


def every_tenth():
    return F.col("vec_id") % 10 == 0


def hard_by_force(rows, every=10, positives=5, negatives=5, share=80):
    whole = sorted(
        {
            (i, label, tuple(math.floor(256 * float(np.float32(x))) for x in vector))
            for i, vector, label, *_ in rows
            if i is not None and label is not None and vector is not None
            and all(x is not None and math.isfinite(x) for x in vector)
        }
    )
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    found, done = [], set()
    for i, label, vector in whole:
        if i % every or i in done:
            continue
        done.add(i)
        others = sorted((-score(vector, v), j, other) for j, other, v in whole if j != i)
        near = [(j, -s) for s, j, other in others if other == label][:positives]
        for j, best in near:
            hard = [(k, -s) for s, k, other in others if other != label and share * best <= -100 * s <= 100 * best]
            found += [(i, j, n, k, best, s) for n, (k, s) in enumerate(hard[:negatives], 1)]
    return sorted(found)


def clustered(seed: int, n: int, dim: int = 6) -> list[tuple]:
    """Vectors around few centres; a third of them the same one."""
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(5, dim))
    rows = []
    for i in range(n):
        vector = centres[0] if i % 3 == 0 else centres[draw.integers(5)] + draw.normal(scale=0.2, size=dim)
        rows.append((i, [float(x) for x in vector], int(draw.integers(4)), 0, 0))
    return rows


@pytest.mark.parametrize("codes, shard, probe", [(32, 8192, 2048), (3, 40, 1), (4, 7, 50)])
def test_hard_negatives_by_force(spark, monkeypatch, codes, shard, probe):
    monkeypatch.setattr(hard_negatives, "SHARD", shard)
    monkeypatch.setattr(hard_negatives, "PROBE", probe)
    rows = clustered(codes, 400)
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, EMBEDDINGS), every_tenth, codes=codes)
    want = hard_by_force(rows)
    assert len(want) > 200
    assert sorted(map(tuple, got.collect())) == want


def test_hard_negatives_odd_rows(spark):
    one = [1.0, 0.5]
    rows = [
        (0, one, 1, 0, 0),
        (0, one, 1, 0, 0),
        (0, one, 2, 0, 0),
        (10, [], 1, 0, 0),
        (20, [0.0, 0.0], 1, 0, 0),
        (30, [-1.0], 1, 0, 0),
        *[(i, one, 1, 0, 0) for i in range(1, 10)],
        *[(i, [0.9, 0.5], 2, 0, 0) for i in (11, 12, 12, 13, 14, 15, 16)],
        (17, [1e30, -1e30], 2, 0, 0),
        (40, None, 1, 0, 0),
        (50, one, None, 0, 0),
        (None, one, 1, 0, 0),
        (60, [1.0, None], 1, 0, 0),
        (61, [float("nan"), 1.0], 2, 0, 0),
        (62, [float("inf"), 1.0], 2, 0, 0),
    ]
    got = hard_negatives.hard_negatives(spark.createDataFrame(rows, EMBEDDINGS), every_tenth).collect()
    assert sorted(tuple(r) for r in got if r["negative_id"] != 17) == [
        r for r in hard_by_force(rows) if r[3] != 17
    ]
    assert {r["anchor_id"] for r in got} == {0, 10, 20}
    empty = spark.createDataFrame([], EMBEDDINGS)
    assert hard_negatives.hard_negatives(empty, every_tenth).collect() == []
    alone = spark.createDataFrame([(0, one, 1, 0, 0)], EMBEDDINGS)
    assert hard_negatives.hard_negatives(alone, every_tenth).collect() == []


def test_cells_come_in_the_order_of_their_bounds():
    draw = np.random.default_rng(4)
    books = draw.normal(size=(7, 3)), draw.normal(size=(5, 3))
    rows = [{"cell": c, "of": c % 3, "first": 0.1, "second": 0.2} for c in range(35)]
    cells = hard_negatives.Cells(books, rows)
    one, _, two, _ = cells.reach(draw.normal(size=(1, 6)))
    visited = list(cells.in_order(one[0], two[0]))
    bounds = [bound for bound, _ in visited]
    assert bounds == sorted(bounds, reverse=True)
    assert sorted(cell for _, cell in visited) == [c for c in range(35) if c % 3]
    for bound, cell in visited:
        assert bound == pytest.approx(one[0][cell // 5] + two[0][cell % 5])


def test_most_cells_are_not_visited_where_vectors_lie_apart(spark):
    """The bounds prune: far clusters are never scored."""
    draw = np.random.default_rng(8)
    centres = np.concatenate([np.eye(8), -np.eye(8)]) * 4
    rows = [(i, [float(x) for x in centres[i % 16] + draw.normal(scale=0.02, size=8)], i % 3, 0, 0) for i in range(3200)]
    whole = hard_negatives.taking_part(spark.createDataFrame(rows, EMBEDDINGS))
    index = hard_negatives.Index(whole)
    asked = whole.where(every_tenth()).selectExpr(
        "vec_id AS anchor_id", "label", "vector", "array(1048576L * 15) AS lows", "array(1L << 62) AS highs"
    )
    visits = index.visits(asked, True).unionAll(index.visits(asked, False))
    cells = visits.select("id", F.explode("cells").alias("cell")).distinct().collect()
    scored = sum(int(index.cells.sizes[r["cell"]]) for r in cells)
    assert scored < 0.2 * len(rows) * len(rows) / 10


# Importance resampling.

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def resampled_by_force(docs, target, run=1, buckets=10_000, least=20, drawn=10, seed=2024):
    def words(text):
        return WORD.findall((text or "").translate(ASCII_LOWER))

    def features(text):
        found = words(text)
        grams = [" ".join(found[i : i + n]) for n in range(1, run + 1) for i in range(len(found) - n + 1)]
        return [zlib.crc32(gram.encode()) % buckets for gram in grams]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * s_all / ((s[k] + 1) * t_all)))
    rows = []
    for doc_id, text in docs:
        found = features(text)
        weight, score = sum(map(gain, found)), None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, len(words(text))])
    may = sorted((r for r in rows if r[3] is not None and r[5] >= least), key=lambda r: (-r[3], r[0]))
    for rank, row in enumerate(may[: drawn * len(may) // 100], 1):
        row[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def test_resampling_query_by_force(spark, con, sf_dir):
    docs = con.sql("SELECT doc_id, text FROM documents").fetchall()
    target = [text for (text,) in con.sql("SELECT text FROM benchmark").fetchall()]
    got = entry_points.queries()["op12_importance_resampling"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == resampled_by_force(docs, target)


@pytest.mark.parametrize("run, buckets, at_once", [(1, 10_000, 3), (2, 50, 1 << 16), (3, 997, 7)])
def test_resampling_odd_rows_by_force(spark, monkeypatch, run, buckets, at_once):
    monkeypatch.setattr(resampling, "AT_ONCE", at_once)
    docs = data.documents(spark)
    target = ["Time year PEOPLE", None, "", "Été man-thing woman"]
    benchmark = spark.createDataFrame([(i, x, 0) for i, x in enumerate(target)], "item_id long, text string, bucket int")
    got = resampling.resample(docs, benchmark, run, buckets, drawn=50)
    rows = [(r[0], r[1]) for r in data.document_rows()]
    want = resampled_by_force(rows, target, run, buckets, drawn=50)
    # The two texts of one id have one noise; equal ids may change places only if equal in score.
    assert sorted(map(tuple, got.collect()), key=str) == want
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_ngrams_do_not_cross_documents():
    texts = [b"one two", b"", b"three", b"four  FIVE six"]
    batch = resampling.Batch(texts)
    counted = [np.bincount(owner, minlength=4).tolist() for owner, _ in batch.features(3, 100)]
    assert counted == [[2, 0, 1, 3], [1, 0, 0, 2], [0, 0, 0, 1]]


def test_resampling_empty_tables(spark):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(data.documents(spark, []), benchmark).collect() == []
    found = resampling.resample(data.documents(spark), benchmark)
    assert found.count() == len(data.document_rows())


def test_rank_of_an_id_with_many_rows(spark):
    rows = [(7, "word " * 30)] * 3000 + [(i, "word " * 30) for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    benchmark = spark.createDataFrame([(1, "word")], "item_id long, text string")
    found = resampling.resample(docs, benchmark, drawn=100).collect()
    assert sorted(r["rank"] for r in found) == list(range(1, 3101))
    in_order = sorted(found, key=lambda r: r["rank"])
    assert [(-r["score"], r["doc_id"]) for r in in_order] == sorted((-r["score"], r["doc_id"]) for r in found)


# SentencePiece.


@pytest.fixture(scope="module")
def vocabulary():
    return sentence_pieces.Vocabulary(MODEL)


def test_agenda_gives_the_ids_of_the_library(vocabulary):
    draw = random.Random(11)
    parts = ["a", "b", " ", "  ", "▁", "\n", "\t", "é", "日本", "😀", "\x00", "the", " the", "ing", "0", "12"]
    parts += ["<s>", "</s>", "<unk>", "<0x41>", "́", "\r", "xx", "%%%", "...", "Ünï"]
    for _ in range(5000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 16)))
        ids = vocabulary.encode(text)
        assert ids == vocabulary.library.encode(text)
        assert vocabulary.decode(ids) == vocabulary.library.decode(ids)


def odd_texts(seed, n):
    draw = random.Random(seed)
    parts = ["a", "aa", "b", " ", "  ", "▁", "\n", "é", "日本", "한국", "😀", "\x00", "the", " the", "ing", "0", "12"]
    parts += ["<s>", "<unk>", "<0x41>", "\u0301", "\r", "xx", "%%%", "----", "Ünï", "\u0f00", "\U000e0001"]
    return ["".join(draw.choices(parts, k=draw.randint(0, draw.choice([3, 16, 60])))) for _ in range(n)]


def is_as_library(vocabulary, texts):
    ids, ends = vocabulary.encode_all(texts)
    decoded = vocabulary.decode_all(ids, ends)
    found = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    assert found == [vocabulary.library.encode(text) for text in texts]
    assert decoded == [vocabulary.library.decode(one) for one in found]
    shown = [hashlib.sha256(",".join(map(str, one)).encode()).hexdigest() for one in found]
    assert vocabulary.id_digests(ids, ends) == shown


def test_new_words_are_merged_together(vocabulary, monkeypatch):
    """Python works through one agenda at a time for long words only."""
    draw = random.Random(13)
    words = ["".join(draw.choices("aeinorsté.&", k=draw.randint(1, 31))) for _ in range(3000)]
    alone = []
    merged = vocabulary.merged
    monkeypatch.setattr(vocabulary, "merged", lambda word: alone.append(word) or merged(word))
    vocabulary.kept.clear()
    assert vocabulary.encode(" ".join(words)) == vocabulary.library.encode(" ".join(words))
    assert alone == []
    assert vocabulary.encode("onetion" * 20) == vocabulary.library.encode("onetion" * 20)
    assert len(alone) == 1


def test_blocks_of_odd_texts(vocabulary, monkeypatch):
    for seed in range(6):
        is_as_library(vocabulary, odd_texts(seed, 300))
    is_as_library(vocabulary, [])
    is_as_library(vocabulary, ["", ""])
    is_as_library(vocabulary, ["", " ", "", "\n", "a" * 31, "a" * 32, "a" * 33, "\u0f00" * 40, ""])
    monkeypatch.setattr(sentence_pieces, "DECODED", 7)
    monkeypatch.setattr(sentence_pieces, "MERGED", 3)
    monkeypatch.setattr(vocabulary.kept, "most", 10)
    is_as_library(vocabulary, odd_texts(7, 300))
    vocabulary.check()
    assert not vocabulary.wrong


def test_pairs_that_share_a_hash_are_searched_for(vocabulary, monkeypatch):
    monkeypatch.setattr(vocabulary.pairs, "place", np.full_like(vocabulary.pairs.place, -1))
    vocabulary.kept.clear()
    is_as_library(vocabulary, odd_texts(8, 300))


def test_words_unlike_the_library_are_told(monkeypatch):
    own = sentence_pieces.Vocabulary(MODEL)
    own.pairs.made[own.pairs.made == own.ids["th"]] = own.pairs.other
    own.pairs.made[own.pairs.made == own.ids["the"]] = own.pairs.other
    own.pairs.made[own.pairs.made == own.ids["▁th"]] = own.pairs.other
    texts = ["some words", "those words", "no  such words", "two  of those", ""]
    ids, ends = own.encode_all(texts)
    monkeypatch.setattr(sentence_pieces, "CHECKED", 3)
    own.check()
    decoded = own.decode_all(ids, ends)
    told = [own.as_library(t, ids[a:b], d) for t, a, b, d in zip(texts, ends, ends[1:], decoded)]
    assert told == [True, False, True, False, True]
    assert own.wrong == {"▁those"}


def test_any_ids_are_decoded_as_by_the_library(vocabulary):
    draw = random.Random(12)
    kinds = [lambda: draw.randrange(32_000), lambda: draw.randrange(262), lambda: draw.choice([0, 1, 2, 259, 28705])]
    for _ in range(5000):
        ids = [draw.choice(kinds)() for _ in range(draw.randint(0, 9))]
        assert vocabulary.decode(ids) == vocabulary.library.decode(ids)


def test_kept_words_are_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(vocabulary.kept, "most", 50)
    for seed in range(30):
        text = data.prose(seed, 40)
        assert vocabulary.encode(text) == vocabulary.library.encode(text)
        assert len(vocabulary.kept) <= 50 + 2 * 40
    long = "x" * 1000
    vocabulary.encode(long)
    assert not any(len(word) > sentence_pieces.KEPT_LENGTH for word in vocabulary.kept)


def test_other_models_are_refused(vocabulary):
    with pytest.raises(ValueError):
        vocabulary.require(False, "merges")


def pieces_by_library(rows, vocabulary):
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    found = []
    for doc_id, text in rows:
        ids = vocabulary.library.encode(text or "")
        decoded = digest(vocabulary.library.decode(ids))
        found.append((doc_id, len(ids), digest(",".join(map(str, ids))), decoded, True))
    return sorted(found, key=str)


def test_pieces_query_by_library(spark, con, sf_dir, vocabulary):
    got = entry_points.queries()["op13_sentencepiece"](spark, sf_dir)
    rows = con.sql("SELECT doc_id, text FROM documents").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == pieces_by_library(rows, vocabulary)


def test_pieces_odd_rows(spark, vocabulary):
    docs = data.documents(spark)
    rows = [(r[0], r[1]) for r in data.document_rows()]
    got = sentence_pieces.digests(docs, MODEL)
    assert sorted(map(tuple, got.collect()), key=str) == pieces_by_library(rows, vocabulary)
    given = sentence_pieces.encoded(docs, MODEL).collect()
    assert sorted((r["decoded"] for r in given)) == sorted(text or "" for _, text in rows)
    assert sorted(len(r["ids"]) for r in given) == sorted(len(vocabulary.library.encode(t or "")) for _, t in rows)
    assert sentence_pieces.digests(data.documents(spark, []), MODEL).collect() == []


def test_pieces_that_recur_are_kept_while_others_pass():
    from folioscan.llm.pretokens import Kept

    kept = Kept(20)
    for i in range(50):
        fresh = kept.lacking({"often", f"once{i}", f"only{i}"})
        assert ("often" in fresh) == (i == 0)
        kept.update(dict.fromkeys(fresh, 0))
        assert len(kept) + len(kept.older) <= 20
