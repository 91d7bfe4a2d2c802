"""Operators against SQL, brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import html
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from folioscan.llm import (
    chat_format,
    decontaminate,
    html_extract,
    langid,
    ngram_join,
    packing,
    pu_quality,
    quality_rules,
    text_stats,
    token_counts,
    toxicity,
)
from tests.llm import data
from tests.oracle import connect, rows_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
OURS = [name for name in entry_points.queries() if name.startswith("op") or name == "pipeline"]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.fixture(scope="module")
def con_of_many():
    """A table with enough labels to hold some of them out."""
    folder = "/root/testdata/sf0.1"
    return folder, connect(folder)


@pytest.fixture(scope="module")
def docs(con):
    return dict(con.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_every_query_is_registered():
    assert {re.match(r"op\d+|pipeline", name)[0] for name in OURS} == {f"op{n}" for n in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("name", [name for name in OURS if name in entry_points.oracle_sql()])
def test_query_equals_its_sql(spark, con, sf_dir, name):
    got = entry_points.queries()[name](spark, sf_dir)
    want = con.sql(entry_points.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    wanted = want.select(*(duckdb.ColumnExpression(c) for c in columns)).fetchall()
    assert rows_of(got.select(*columns).collect()) == rows_of(wanted)


@pytest.mark.parametrize("name", ["op2_chat_formatting", "op3_benchmark_decontamination"])
def test_native_plans_hold_no_python(spark, sf_dir, name):
    plan = entry_points.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|BroadcastNestedLoop", plan)


# Chat formatting.


def test_chats_read_back_whatever_they_say(spark):
    draw = random.Random(3)
    parts = ["\\", "#", "###", " ", "\n", "</turn>", "user", ": ", "Assistant", "x", "</", "turn>", "é"]
    text = lambda: "".join(draw.choice(parts) for _ in range(draw.randint(0, 12)))
    rows = [(i // 4, i % 4, text(), text()) for i in range(2000)]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat_format.parse_chats(chats).collect()}
    want = defaultdict(list)
    for conv_id, _, role, said in rows:
        want[conv_id].append((role, said))
    assert got == dict(want)
    for row in chats.collect():
        assert "".join(s["text"] for s in row["segments"]) == row["formatted"]


@pytest.mark.parametrize("role", ["a:" * 100_000, "\\" * 100_000, "#<\n:" * 30_000, "x" * 300_000])
def test_roles_with_thousands_of_escapes_read_back(spark, role):
    rows = [(1, 0, role, "### no </turn>"), (1, 1, "assistant", role)]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (row,) = chat_format.parse_chats(chats).collect()
    assert [tuple(t) for t in row["turns"]] == [(role, "### no </turn>"), ("assistant", role)]


def test_only_what_conflicts_is_escaped(spark):
    rows = [(1, 0, "user", "plain \\ text"), (1, 1, "assistant", "### no")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (row,) = chats.collect()
    assert row["formatted"] == "### user: plain \\ text\n</turn>\n### assistant: \\### no\n</turn>\n"
    assert [s["text"] for s in row["segments"] if s["loss"]] == ["\\### no"]


# Decontamination.


def test_masks_find_every_place_with_two_other_words():
    """However two of thirteen words differ, one mask fits between them."""
    window = decontaminate.WINDOW
    for one in range(window):
        for two in range(one):
            assert any(
                not {one, two} & {start + place for place in mask}
                for mask in decontaminate.MASKS
                for start in range(window - mask[-1])
            )


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_repeated_items_by_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", broadcast)
    draw = random.Random(broadcast)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(i, passage(draw.choice([3, 5, 8, 12, 13, 20, 90]))) for i in range(25)]
    texts = []
    for i in range(120):
        words = passage(draw.randint(0, 150))
        _, item = draw.choice(items)
        copy = list(item[draw.randint(0, 3) : len(item) - draw.randint(0, 3)])
        for _ in range(draw.randint(0, 4)):
            if copy:
                copy[draw.randrange(len(copy))] = "other"
        at = draw.randint(0, len(words))
        texts.append((i, ", ".join(words[:at] + copy + words[at:]).title()))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = sorted(map(tuple, decontaminate.repeated_items(docs, bench).collect()))
    want = {}
    for doc_id, text in texts:
        words = re.findall(r"[^\W_]+", text.lower())
        for item_id, item in items:
            n = min(len(item), 13)
            need = 11 if n == 13 else n
            if n < 5:
                continue
            for shift in range(-len(item), len(words)):
                equal = [0 <= p + shift < len(words) and words[p + shift] == w for p, w in enumerate(item)]
                for p, same in enumerate(equal):
                    found = sum(equal[p : p + 13])
                    if same and found >= need:
                        most, start = want.get((doc_id, item_id), (0, 10**9))
                        want[doc_id, item_id] = (max(most, found), min(start, p + shift))
    assert want and got == sorted((*key, *value) for key, value in want.items())


# Similarity join.


def shingle_sets(texts: dict, size: int = 4) -> dict:
    def of(text):
        words = text.translate(ASCII_LOWER).encode().split()
        starts = range(max(1, len(words) - size + 1))
        return frozenset(tuple(words[i : i + size]) for i in starts) if words else frozenset()

    return {doc_id: of(text or "") for doc_id, text in texts.items()}


def components_by_force(sets: dict, share: int = 85) -> dict:
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if sets[a] and 100 * shared >= share * len(sets[a] | sets[b]):
                one, two = find(a), find(b)
                root[max(one, two)] = min(one, two)
    return {i: find(i) for i in sets}


def joined(df) -> dict:
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_join(df).collect()}


def test_ngram_join_on_the_table(spark, sf_dir, docs):
    sets = shingle_sets(docs)
    root = components_by_force(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in entry_points.queries()["op4_ngram_jaccard_join"](spark, sf_dir).collect()}
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_ngram_join_by_force(spark, seed):
    """Chains of edits near the limit, common passages, short and repeated texts."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    common, templates, texts = prose(40), [prose(n) for n in (12, 30, 70, 160)], {}
    for i in range(160):
        kind = draw.random()
        words = list(draw.choice(templates)) if kind < 0.7 else prose(draw.randint(0, 60))
        if kind < 0.7:
            for _ in range(draw.randint(0, 3)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            if i > 20 and kind < 0.3 and texts[i - 1]:
                words = texts[i - 1].split()
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
        if kind > 0.9:
            words = words[:5] + common
        texts[i] = draw.choice([" ", "\n", "  "]).join(words)
    sets = shingle_sets(texts)
    root = components_by_force(sets)
    assert len(set(root.values())) < len(texts)
    got = joined(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5))
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_join_with_other_numbers_by_force(spark, seed):
    """Five words and four fifths, as the pipeline asks for: blocks added or words changed near the limit."""
    draw = random.Random(seed)
    prose = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    texts = {}
    for i in range(0, 120, 2):
        words = prose(draw.choice([20, 60, 150]))
        texts[i] = " ".join(words)
        if i % 4:
            texts[i + 1] = " ".join(words + prose(round(len(words) * draw.uniform(0.1, 0.35))))
        else:
            for at in draw.sample(range(len(words)), max(1, len(words) // 45)):
                words[at] = "other"
            texts[i + 1] = " ".join(words)
    split = {i: t.split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in split.items()}
    shares = {i: 100 * len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in texts if i % 2 == 0}
    assert any(80 <= s < 85 for s in shares.values()) and any(s < 80 for s in shares.values())
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", "'en' lang", "'s' source", "0L n_chars").repartition(3)
    left = {r["doc_id"] for r in corpus_pipeline.similarity(spark, docs, "").collect()}
    assert left == {i for i in texts if i % 2 == 0 or shares[i - 1] < 80}


def test_one_of_each_keeps_least_ids(spark):
    same = "one two three four five six seven"
    rows = [(5, same), (3, same), (3, same), (None, same), (7, ""), (8, None), (9, "other words entirely here now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("x", "y")
    left = ngram_join.one_of_each(df).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left if r["doc_id"] != 8) == [(3, same), (7, ""), (9, rows[-1][1])]
    assert len(left) == 4


# Tokens and packing.


def awkward_texts() -> list[str]:
    draw = random.Random(1)
    parts = [" ", "  ", "\n", "a", "the", "!", "1", "é", "　", "\t", "'s", "<|endoftext|>", "\x1c", "\xa0", "ß", "日本", "\0"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for _ in range(1500)]
    return [*texts, "", "aaaa" * 2000, "x\n \ny", "x\n <|endoftext|>", "‎ՠ a", "don't DON'T", "abcabcabc" * 300]


def test_token_counts_are_those_of_the_library(library, docs):
    texts = [*awkward_texts(), *docs.values()]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter(PATH).all(texts, together=5000) == want


def test_ids_are_those_of_the_library_also_when_pieces_are_forgotten(library, docs):
    texts = [*awkward_texts(), *docs.values()]
    want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    ids = packing.Ids(PATH)
    ids.kept.most = 3000
    assert ids.all(texts, together=5000) == want


def test_token_query(spark, sf_dir, docs, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in entry_points.queries()["op5_token_counts"](spark, sf_dir).collect()}
    for doc_id, text in docs.items():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert got[doc_id] == (len((text or "").encode()), n, n > 512)


def check_packing(rows, texts: dict, library) -> int:
    """Pieces are right and fill sequences without gaps; returns the number of sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(-(-len(ids) // 2048)))
        assert all(r["length"] == 2048 for r in pieces[1:])
        at = 0
        for r in pieces:
            assert r["start"] == at
            part = np.array(ids[at : at + r["length"]], "<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return len(by_sequence)


def test_packing_query(spark, sf_dir, docs, library):
    rows = entry_points.queries()["op8_best_fit_packing"](spark, sf_dir).collect()
    n = check_packing(rows, docs, library)
    assert n <= 1.02 * sum(r["length"] for r in rows) / 2048 + 1


@pytest.mark.parametrize("seed", range(30))
def test_plans_hold_every_piece_and_are_near_the_bound(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 50, 300])
    counts = Counter(draw.randint(1, capacity) for _ in range(draw.choice([1, 7, 200, 3000])))
    held = Counter()
    n = 0
    for lengths, times in packing.plan(counts, capacity):
        assert times > 0 and sum(length * each for length, each in lengths) <= capacity
        n += times
        for length, each in lengths:
            held[length] += each * times
    assert held == counts
    least = max(-(-sum(k * c for k, c in counts.items()) // capacity), sum(c for k, c in counts.items() if 2 * k > capacity))
    assert n <= least * 11 / 9 + 1


@pytest.mark.parametrize("seed", range(40))
def test_reduction_loses_no_optimum(seed):
    """What is fixed, with the best packing of the rest, is a best packing of all."""
    draw = random.Random(seed)
    items = [draw.randint(1, 12) for _ in range(draw.randint(1, 8))]

    def best(sizes) -> int:
        sizes = sorted(sizes, reverse=True)
        least = [len(sizes)]

        def place(i, rooms):
            if len(rooms) >= least[0]:
                return
            if i == len(sizes):
                least[0] = len(rooms)
                return
            for j in {r: j for j, r in enumerate(rooms) if r >= sizes[i]}.values():
                place(i + 1, [*rooms[:j], rooms[j] - sizes[i], *rooms[j + 1 :]])
            place(i + 1, [*rooms, 12 - sizes[i]])

        place(0, [])
        return least[0]

    counts = np.bincount(items, minlength=13)
    fixed = packing.reduce_dominated(counts, 12)
    rest = [length for length, c in enumerate(counts) for _ in range(c)]
    assert sum(n for _, n in fixed) + (best(rest) if rest else 0) == best(items)


# Statistics, rules and classifiers.


def stats_by_force(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            repeated |= set(range(i, i + 5))
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_stats_by_force(docs):
    odd = ["", "a", "a a a a a a", "x y z x y z x y z w", "l\nl\n \n \nl ", "\x1c\x85\xa0 é|#", "a b c"]
    for text in [*odd, *docs.values()]:
        assert text_stats.stats(text)[:5] == stats_by_force(text)


def test_rules_query(spark, sf_dir, docs, con):
    rows = entry_points.queries()["op6_quality_rules"](spark, sf_dir).collect()
    labels = dict(con.sql("SELECT doc_id, quality FROM labels").fetchall())
    kept = Counter()
    for r in rows:
        stats = stats_by_force(docs[r["doc_id"]])
        assert tuple(r)[1:6] == stats
        assert r["base_failed"] == (stats[0] < 10 or 100 * stats[4] > 20 * stats[0])
        assert not (r["base_failed"] and r["kept"])
        if not r["base_failed"] and r["doc_id"] in labels:
            kept[labels[r["doc_id"]], r["kept"]] += 1
    assert kept[1, True] >= 0.97 * (kept[1, True] + kept[1, False])


def test_rules_learn_thresholds_and_leave_the_rest():
    draw = np.random.default_rng(0)
    rows = {name: draw.integers(0, 1000, 3000) for name in quality_rules.FEATURES}
    bad = (rows["symbols"] > 800) | ((rows["distinct"] < 200) & (rows["n_words"] > 500))
    rules = quality_rules.learn(rows, bad, np.arange(3000))
    found = np.zeros(3000, dtype=bool)
    for rule in rules:
        found |= quality_rules.covers(rule, rows)
    assert (found & ~bad).sum() <= 15 and (found & bad).sum() >= 0.9 * bad.sum()


def test_the_decision_list_in_spark_is_that_in_numpy(spark):
    rules = [
        (quality_rules.Condition("symbols", True, 5), quality_rules.Condition("n_words", False, 50)),
        (quality_rules.Condition("repeated", True, 300),),
    ]
    rows = [{name: (i * 37 + j * 101) % 700 // (1 + j) for j, name in enumerate(quality_rules.FEATURES)} for i in range(200)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{n} long" for n in quality_rules.FEATURES))
    got = [r[0] for r in df.select(quality_rules.verdict(rules)).collect()]
    arrays = {name: np.array([r[name] for r in rows]) for name in quality_rules.FEATURES}
    want = ~(quality_rules.covers(rules[0], arrays) | quality_rules.covers(rules[1], arrays))
    assert got == want.tolist()


def area(labels, scores) -> float:
    """Chance that a document of label 1 has a higher score than one of label 0."""
    ones = [s for y, s in zip(labels, scores) if y]
    noughts = [s for y, s in zip(labels, scores) if not y]
    return sum((a > b) + (a == b) / 2 for a in ones for b in noughts) / (len(ones) * len(noughts))


def test_samples_are_bounded_by_ids_and_rows(spark):
    """One id holds nine tenths of the rows."""
    from folioscan.llm.common import rows_of, sample_ids

    rows = [(0, f"hot {i % 500}", "en") for i in range(5000)] + [(i, f"text {i}", "en") for i in range(1, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    for bound in (10, 50, 1200):
        ids = sample_ids(docs.select("doc_id", F.col("lang").alias("label")), bound)
        assert len(ids) == min(bound, 500)
        assert rows_of(docs, ids, "string").count() == len(ids)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(500)], "doc_id long, quality int, toxic int")
    assert toxicity.learned(docs, labels) is not None
    assert pu_quality.learned(docs, labels) is not None
    assert langid.learned(docs) is not None
    assert quality_rules.learned_rules(docs, labels) is not None


def test_toxicity_held_out(spark, con_of_many):
    """On held-out labels of a small table: most toxic documents are found, clean ones left alone.

    A few hundred toxic documents to learn from give a recall of little over one half; the
    check's tables, with some thousands, one of 0.98.
    """
    folder, con = con_of_many
    found = {r["doc_id"]: r for r in entry_points.queries()["op1_toxicity"](spark, folder).collect()}
    rows = con.sql("SELECT doc_id, toxic FROM labels WHERE toxic IS NOT NULL").fetchall()
    held = {i: toxic for i, toxic in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found.values())
    caught = [found[i]["predicted"] for i, toxic in held.items() if toxic]
    flagged = [found[i]["predicted"] for i, toxic in held.items() if not toxic]
    assert len(caught) > 50 and sum(caught) >= 0.5 * len(caught), (sum(caught), len(caught))
    assert sum(flagged) <= 0.05 * len(flagged), (sum(flagged), len(flagged))


def test_rules_reject_bad_labels(spark, con_of_many):
    folder, con = con_of_many
    kept = {r["doc_id"]: r["kept"] for r in entry_points.queries()["op6_quality_rules"](spark, folder).collect()}
    rows = con.sql("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL").fetchall()
    good, bad = ([kept[i] for i, quality in rows if quality == q] for q in (1, 0))
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_toxicity_knows_misspellings_it_never_saw():
    draw = random.Random(2)
    stems = ["horrid", "wretch", "scoundrel", "vermin"]
    ends = ["", "s", "ly", "ish", "zz", "ed"]

    def text(toxic: bool, endings: list[str]) -> str:
        words = [draw.choice(data.WORDS) + draw.choice(["", "s", "er"]) for _ in range(60)]
        if toxic:
            for _ in range(3):
                words[draw.randrange(60)] = draw.choice(stems) + draw.choice(endings)
        return " ".join(words)

    labels = [i % 2 for i in range(400)]
    model = toxicity.train([text(bool(y), ends[:4]) for y in labels], labels)
    scorer = toxicity.Scorer(model)
    scores = scorer.scores([text(bool(y), ends[4:]) for y in labels])
    assert area(labels, scores) > 0.97
    assert all(0 <= s <= 1 for s in scorer.scores(["", "x", "horrid " * 3]))
    assert toxicity.train(["a", "b"], [1, 1]) is None


def test_languages_held_out(spark, sf_dir, con):
    rows = entry_points.queries()["op7_language_id"](spark, sf_dir).collect()
    lang = dict(con.sql("SELECT doc_id, lang FROM documents").fetchall())
    held = [r for r in rows if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_texts_without_letters_have_no_language():
    model = langid.train(["hello there you", "bonjour les amis"] * 3, ["en", "fr"] * 3)
    assert [langid.predict(t, model) for t in ("", "12 !?", "\n")] == [("und", 0.0)] * 3
    assert langid.predict("there", model)[0] == "en" and langid.predict("日本", model)[0] in ("en", "fr")
    assert langid.predict("there", None) == ("und", 0.0)


def test_quality_held_out(spark, con):
    folder = "/root/testdata/sf0.01"
    rows = entry_points.queries()["op9_quality_classifier"](spark, folder).collect()
    labels = dict(connect(folder).sql("SELECT doc_id, quality FROM labels").fetchall())
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert area([labels[r["doc_id"]] for r in held], [r["score"] for r in held]) > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_class_prior_is_found():
    draw = np.random.default_rng(1)
    good, bad = draw.normal(0, 1, (6000, 4)), draw.normal(3, 1, (6000, 4))
    for share in (0.3, 0.7):
        n = int(3000 * share)
        mixed = np.concatenate([good[3000 : 3000 + n], bad[: 3000 - n]])
        draw.shuffle(mixed)
        prior = pu_quality.class_prior(good[:3000], mixed)
        assert abs(prior - share) < 0.1
        net = pu_quality.fit(good[:3000], mixed, lambda m, k, p=prior: pu_quality.risk_slope(m, k, p), epochs=20)
        right = ((net.margin(good[-500:]) > 0).mean() + (net.margin(bad[-500:]) < 0).mean()) / 2
        assert right > 0.95


# Pages.


def test_pages_query_by_force(spark, sf_dir, con):
    got = {r["page_id"]: r for r in entry_points.queries()["op10_html_extraction"](spark, sf_dir).collect()}
    pages = con.sql("SELECT page_id, url, html FROM pages").fetchall()
    assert len(got) == len(pages)
    for page_id, url, page in pages:
        article = re.search(r"<article>(.*)</article>", page, flags=re.S)[1]
        blocks = re.split(r"</?p>|</?h1>|<br>", re.sub(r"</?b>", "", article))
        lines = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in blocks]
        assert got[page_id]["text"] == "\n".join(x for x in lines if x)
        assert got[page_id]["url"] == url


PAGE = """<!DOCTYPE html><html><head><title>{i}</title><script>var a = "</div><p>no</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><div id="cookie-notice">We use cookies</div>
<div class="wrap"><div class="post"><h1>Title {i}</h1><p>Body &amp; text {i}<i>, more</i> of it</p><p>{long}</p>
<div class="advert">Buy {i}</div><form><input>Subscribe {i}</form><p>Always the same line</p></div>
<aside>Also {i}</aside><section id="comments"><p>Reader says {long}</p></section></div><footer>c {i}</footer></body></html>"""


def test_template_of_pages_without_article(spark):
    words = lambda i: " ".join(data.prose(i, 40).split())
    rows = [(i, "http://host.example/%d" % i, PAGE.format(i=i, long=words(i))) for i in range(12)]
    rows += [(99, "http://other.example/x", PAGE.format(i=99, long=words(99)))]
    found = html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in found:
        i = r["page_id"]
        want = [f"Title {i}", f"Body & text {i}, more of it", words(i)]
        # Twelve pages tell that a line is the host's; one page cannot.
        assert r["text"].split("\n") == (want if i < 99 else [*want, "Always the same line"])


def host_texts(spark, bodies: list[str]) -> dict:
    """The text of each body as a page of one host."""
    rows = [(i, f"http://host.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    found = html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r["page_id"]: r["text"] for r in found}


def test_lines_that_stand_twice_are_the_templates_too(spark):
    own = [data.prose(i, 40) for i in range(20)]
    body = "<div class='wrap'><p>Share this</p><div class='post'><p>{}</p><p>Once</p>{}</div><p>Share this</p></div>"
    # On one page the line that stands once elsewhere stands twice; another line stands twice on every page.
    got = host_texts(spark, [body.format(text, "<p>Once</p>" * (i == 7)) for i, text in enumerate(own)])
    assert got == dict(enumerate(own))
    # The same for the tags that enclose the article.
    body = "<p>Menu of {0}</p><div class='post'><p>{1}</p></div><p>Seen {0} times</p>"
    more = [body.format(i, text) + "<div class='post'>x</div>" * (i == 7) for i, text in enumerate(own)]
    got = host_texts(spark, more)
    assert {i: x for i, x in got.items() if i != 7} == {i: x for i, x in enumerate(own) if i != 7}


def test_the_template_finds_the_slot_of_the_text(spark):
    own = [data.prose(i, 40) for i in range(20)]
    # The only article is a teaser; the text is in another slot.
    body = "<article><p>Tip {0}</p></article><div class='post'><p>{1}</p></div>"
    got = host_texts(spark, [body.format(i, text) for i, text in enumerate(own)])
    assert got == dict(enumerate(own))
    # The text stands in an element whose name says that it is none.
    body = "<nav>Menu {0}</nav><form><div class='sidebar'><p>{1}</p></div></form>"
    got = host_texts(spark, [body.format(i, text) for i, text in enumerate(own)])
    assert got == dict(enumerate(own))


def test_lines_nest_in_one_slot_of_the_template(spark):
    """A line that all pages have, now in one slot and now in another, is no part of the template."""
    own = [data.prose(i, 40) for i in range(20)]
    body = "<article><div class='a'><p>{}</p></div><div class='b'><p>{}</p></div><p>Always here</p></article>"
    pair = lambda i, text: (f"{text}</p><p>So it is", f"End {i}") if i % 2 else (text, f"End {i}</p><p>So it is")
    got = host_texts(spark, [body.format(*pair(i, text)) for i, text in enumerate(own)])
    assert got == {i: f"{text}\nSo it is\nEnd {i}" if i % 2 else f"{text}\nEnd {i}\nSo it is" for i, text in enumerate(own)}


def test_order_of_the_core():
    assert html_extract.in_order([0, 1, 7, 2, 3, 4, 4, 9]) == [True, True, False, True, True, False, True, True]
    assert html_extract.in_order([]) == []


def test_copies_of_an_article_are_no_template(spark):
    own = [data.prose(i, 40) for i in range(12)]
    article = "<article><h1>Head</h1><p>{}</p><p>Second</p></article>"
    copies = [f"<p>Seen {i} times</p>" + article.format(own[0]) for i in range(30)]
    copied = f"Head\n{own[0]}\nSecond"
    assert set(host_texts(spark, copies).values()) == {copied}
    # Repeated rows, and no article to go by.
    assert set(host_texts(spark, [f"<div><p>{own[0]}</p><p>Second</p></div>"] * 30).values()) == {f"{own[0]}\nSecond"}
    # Beside copies, lines of different articles are the template's as before.
    got = host_texts(spark, copies + [article.format(text).replace("<h1>Head</h1>", f"<h1>{i}</h1>") for i, text in enumerate(own)])
    assert {got[i] for i in range(30)} == {f"Head\n{own[0]}"}
    assert [got[30 + i] for i in range(12)] == [f"{i}\n{text}" for i, text in enumerate(own)]


@pytest.mark.parametrize(
    "marks", ["post no-sidebar", "content has-sidebar", "post comments-open", "has_comments", "share-price", "related-work"]
)
def test_only_whole_words_of_a_class_name_no_content(marks):
    page = f"<body><div class='{marks}'><article class='{marks}'><p>One</p><section id='{marks}'><p>Two</p></section>"
    page += "<div class='post sidebar'>no</div><div id='related-posts'>no</div></article></div></body>"
    assert html_extract.main_text(page, set(), set()) == "One\nTwo"
    for name in ("article", "main"):
        assert html_extract.main_text(f"<{name} class='comments'><p>One</p></{name}>", set(), set()) == "One"


# The pipeline.


def test_pipeline_by_force(spark, sf_dir, con, docs, library):
    """Each stage by plain Python on what the one before kept; the models are the operators'."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = langid.learned(table)
    left = {}
    for doc_id, text in docs.items():
        name, score = langid.predict(text or "", model)
        if name != "und" and score >= langid.LEAST_SCORE:
            left[doc_id] = text
    kept = table.where(table["doc_id"].isin(list(left)))
    rules = quality_rules.learned_rules(kept, labels)
    names = [*text_stats.COUNTS, *text_stats.SHARES]
    for doc_id, text in list(left.items()):
        row = {name: np.array([v]) for name, v in zip(names, text_stats.stats(text))}
        base = row["n_words"][0] < 10 or 100 * row["n_repeat_words"][0] > 20 * row["n_words"][0]
        if base or any(quality_rules.covers(rule, row)[0] for rule in rules):
            del left[doc_id]
    root = components_by_force(shingle_sets(left, corpus_pipeline.NEAR_SIZE), corpus_pipeline.NEAR_SHARE)
    left = {i: text for i, text in left.items() if root[i] == i}
    repeated = {row[0] for row in con.sql(decontaminate.CHECK_SQL).fetchall()}
    left = {i: text for i, text in left.items() if i not in repeated}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert 0 < len(left) < len(docs)
    check_packing(rows, left, library)


def test_near_copies_of_the_pipeline_are_of_its_own_numbers(spark, sf_dir):
    """A pair that is linked by five words and four fifths, and not by the numbers of op4."""
    words = [f"w{i}" for i in range(60)]
    texts = {1: " ".join(words), 2: " ".join([*words, *(f"v{i}" for i in range(12))])}
    assert components_by_force(shingle_sets(texts))[2] == 2
    assert components_by_force(shingle_sets(texts, 5), 80)[2] == 1
    docs = data.documents(spark, [(i, text, "en", "s", 0, 0, "") for i, text in texts.items()])
    assert [r["doc_id"] for r in corpus_pipeline.similarity(spark, docs, sf_dir).collect()] == [1]
    assert ngram_join.one_of_each(docs).count() == 2


def test_pipeline_stages_keep_the_columns(spark, sf_dir):
    docs = data.documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == data.documents(spark).columns
    empty = data.documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
