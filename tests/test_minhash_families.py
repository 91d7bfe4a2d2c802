"""The approximate tier, documents made of common passages, families that grow, components."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioscan.operators import components, dedup, families, minhash
from folioscan.session import scratch_path
from tests.test_versions import brute_force, corpus, families_by_force, frame, shingle_set


def found_by(df):
    return {r["b"]: (r["a"], r["jaccard"]) for r in df.collect()}


@pytest.mark.parametrize("seed, threshold, bucket_rows", [(1, 0.5, 50), (2, 0.8, 3), (3, 0.5, 1), (4, 0.6, 2)])
def test_minhash_against_brute_force(spark, seed, threshold, bucket_rows):
    texts = corpus(seed)
    got = found_by(minhash.minhash_duplicates(frame(spark, texts), threshold, 5, bucket_rows))
    want = {b for _, b, _ in brute_force(texts, threshold, 5)}
    assert set(got) <= want and len(got) >= 0.9 * len(want)
    sets = [shingle_set(text, 5) for text in texts]
    for b, (a, jaccard) in got.items():
        assert a < b and jaccard == len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold


def test_signatures_agree_as_often_as_sets_are_similar(spark):
    """Both kinds, over the limit of the short one."""
    draw = random.Random(5)
    for size, kinds in ((40, {0}), (70, {0, 1}), (600, {1})):
        shared = [draw.getrandbits(62) for _ in range(size)]
        rows = []
        for i in range(20):
            own = [draw.getrandbits(62) for _ in range(size // 2)]
            rows.append((i, size + size // 2, shared + own))
        sets = spark.createDataFrame(rows, "doc_id long, n int, shingles array<long>")
        slots = {}
        for r in minhash.signatures(sets, 0.5).collect():
            assert len(r["slots"]) == minhash.SLOTS
            slots.setdefault(r["kind"], []).append(r["slots"])
        assert set(slots) == kinds
        for found in slots.values():
            same = [sum(x == y for x, y in zip(a, b)) for a in found for b in found if a is not b]
            assert abs(sum(same) / len(same) / minhash.SLOTS - 0.5) < 0.06


def test_a_hot_group_costs_its_size(spark, monkeypatch):
    compared = []
    similar = minhash._similar
    monkeypatch.setattr(minhash, "_similar", lambda p, s, t: compared.append(p.count()) or similar(p, s, t))
    totals = []
    for n in (300, 600):
        compared.clear()
        draw = random.Random(6)
        template = [f"w{draw.randrange(3000)}" for _ in range(120)]
        texts = [" ".join([*template, f"own{i}"]) for i in range(n)]
        assert minhash.minhash_duplicates(frame(spark, texts)).count() == n - 1
        totals.append(sum(compared))
    assert totals[1] < 2.5 * totals[0]


def test_recall_of_nothing(spark):
    empty = spark.createDataFrame([], "a long, b long, jaccard double")
    assert tuple(minhash.recall(empty, empty).first()) == (0, 0, 0, None)
    assert minhash.minhash_duplicates(frame(spark, ["", "one two"])).collect() == []


def passages(seed, n, of=4, pool=8):
    """Documents that are each some of a few passages, in any order."""
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    parts = [" ".join(draw.choice(words) for _ in range(30)) for _ in range(pool)]
    return [" ".join(draw.sample(parts, of)) for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_common_passages_cost_less_than_pairs(spark, monkeypatch, threshold):
    """Twice the documents, less than three times the comparisons, and the result of brute force."""
    compared = []
    compare = dedup._compared
    monkeypatch.setattr(dedup, "_compared", lambda p, s: compared.append(p.count()) or compare(p, s))
    totals = {"near": [], "family": []}
    for n in (200, 400):
        texts = passages(3, n)
        compared.clear()
        got = dedup.near_duplicates(frame(spark, texts), threshold, bucket_rows=10)
        assert sorted(map(tuple, got.select("a", "b", "jaccard").collect())) == sorted(brute_force(texts, threshold, 5))
        totals["near"].append(sum(compared))
        if threshold < 0.8:
            continue
        compared.clear()
        family = dedup.version_family(frame(spark, texts), threshold)
        got = sorted(map(tuple, family.select("doc_id", "family").collect()))
        assert got == families_by_force(texts, threshold, 5)
        totals["family"].append(sum(compared))
    for small, large in filter(None, totals.values()):
        assert large < 3 * small


def test_shingles_of_the_same_documents_are_one_item(spark):
    texts = ["a b c d e f g h one", "a b c d e f g h two", "x a b c d e y"]
    sets = dedup._shingle_sets(frame(spark, texts), 5)
    items = dedup._items(sets)
    weights = dedup._weighed(sets, items)
    got = sorted((r["doc_id"], r["df"], r["weight"]) for r in weights.collect())
    assert got == [(0, 2, 3), (0, 3, 1), (1, 2, 3), (1, 3, 1), (2, 3, 1)]
    assert items.select("item").distinct().count() == 2


def roots(df):
    return sorted(map(tuple, df.select("node", "root").collect()))


def roots_by_force(links):
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in links:
        one, two = root(a), root(b)
        above[max(one, two)] = min(one, two)
    return sorted((x, root(x)) for x in above)


def test_components_of_random_links(spark):
    draw = random.Random(1)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(180)] + [(7, 7), (400, 400)]
    assert roots(components.components(spark.createDataFrame(links, "a long, b long"))) == roots_by_force(links)


def test_rounds_of_a_long_chain(spark, monkeypatch):
    """A chain of 10,000 in mixed order: as many rounds as its length has binary digits, about."""
    rounds = []
    small = components._small_star
    monkeypatch.setattr(components, "_small_star", lambda edges: rounds.append(1) or small(edges))
    names = list(range(10_000))
    random.Random(9).shuffle(names)
    links = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    found = components.components(links)
    assert found.where("root = 0").count() == 10_000
    assert len(rounds) <= 14


def test_further_links_join_earlier_components(spark):
    draw = random.Random(2)
    links = [(draw.randrange(10, 150), draw.randrange(10, 150)) for _ in range(60)]
    more = [(draw.randrange(170), draw.randrange(170)) for _ in range(25)]
    before = components.components(spark.createDataFrame(links, "a long, b long"))
    after = components.with_links(before, spark.createDataFrame(more, "a long, b long"))
    assert roots(after) == roots_by_force(links + more)


@pytest.mark.parametrize("seed, threshold", [(1, 0.5)])
def test_deliveries_give_the_families_of_the_whole(spark, seed, threshold):
    texts = corpus(seed)
    path = scratch_path(spark, "families")
    docs = frame(spark, texts)
    for delivery in range(3):
        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == delivery)
        if delivery:
            got = families.add(part, path, delivery, threshold)
        else:
            got = families.start(part, path, threshold)
    assert sorted(map(tuple, got.select("doc_id", "family").collect())) == families_by_force(texts, threshold, 5)
    assert families.families(spark, path, 0).count() < got.count()


def test_a_delivery_of_nothing_and_of_copies(spark):
    path = scratch_path(spark, "families")
    words = " ".join(f"w{i}" for i in range(30))
    texts = frame(spark, [words, words + " one", "unlike all the others there are here"])
    families.start(texts.where("doc_id = 2"), path)
    assert families.add(texts.limit(0), path, 1).collect() == []
    assert families.add(texts.where("doc_id = 1"), path, 2).collect() == []
    got = families.add(texts.where("doc_id = 0"), path, 3)
    assert sorted(map(tuple, got.collect())) == [(0, 0), (1, 0)]
    with pytest.raises(ValueError):
        families.add(texts, path, 0)
