"""Copies, near copies, families and differences against brute force."""

from __future__ import annotations

import random

import pytest

from folioscan.operators import dedup, diff, extract


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def shingle_set(text, k):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_force(texts, threshold, k):
    sets = [shingle_set(t, k) for t in texts]
    found = []
    for b, later in enumerate(sets):
        for a in range(b):
            if later and sets[a]:
                jaccard = len(later & sets[a]) / len(later | sets[a])
                if jaccard >= threshold:
                    found.append((a, b, jaccard))
                    break
    return found


def corpus(seed, n=90):
    """Copies, edits of three templates that share a part, and unrelated texts."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    templates = [[rnd.choice(words) for _ in range(60)] for _ in range(3)]
    templates[1][:35] = templates[0][:35]
    texts = ["", "uno dos", "w1 w2 w3 w4 w5"]
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.4:
            text = list(templates[0])
        elif kind < 0.7:
            text = list(rnd.choice(templates))
        else:
            text = [rnd.choice(words) for _ in range(rnd.randint(3, 60))]
        for _ in range(rnd.randint(0, 4) if kind < 0.7 else 0):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        texts.append((" " if kind < 0.9 else "  ").join(text).upper() if kind < 0.1 else " ".join(text))
    return texts


@pytest.mark.parametrize(
    "threshold, bucket_rows, pivot_rounds, cell_rows",
    [(0.5, 100, 6, 4096), (0.5, 3, 6, 4), (0.5, 3, 0, 4), (0.8, 3, 2, 3), (0.8, 1, 6, 4096), (1.0, 2, 3, 4)],
)
def test_near_duplicates_are_exact(spark, threshold, bucket_rows, pivot_rounds, cell_rows):
    texts = corpus(seed=int(threshold * 10) + bucket_rows)
    got = dedup.near_duplicates(
        frame(spark, texts), threshold, 5, bucket_rows, pivot_rounds, cell_rows
    )
    assert sorted(tuple(r) for r in got.select("a", "b", "jaccard").collect()) == sorted(
        brute_force(texts, threshold, 5), key=lambda r: (r[0], r[1])
    )


def test_a_group_of_near_copies_costs_linear_work(spark, monkeypatch):
    """Twice the copies, about twice the comparisons."""
    compared = []
    compare = dedup._compared

    def counting(pairs, sets):
        compared.append(pairs.count())
        return compare(pairs, sets)

    monkeypatch.setattr(dedup, "_compared", counting)
    totals = []
    for n in (200, 400):
        compared.clear()
        rnd = random.Random(5)
        words = [f"w{i}" for i in range(2000)]
        template = [rnd.choice(words) for _ in range(80)]
        texts = []
        for _ in range(n):
            text = list(template)
            text[rnd.randrange(80)] = rnd.choice(words)
            texts.append(" ".join(text))
        found = dedup.near_duplicates(frame(spark, texts), 0.5, bucket_rows=10)
        assert found.count() == n - 1
        totals.append(sum(compared))
    assert totals[1] < 3 * totals[0]


def test_copies(spark):
    texts = frame(spark, ["x", "y", "x", "z", "y", "x"])
    groups = dedup.exact_duplicates(texts).select("first_doc", "n_docs").collect()
    assert sorted(map(tuple, groups)) == [(0, 3), (1, 2)]
    assert sorted(map(tuple, dedup.exact_copies(texts).collect())) == [(2, 0), (4, 1), (5, 0)]


def test_equal_visible_text_under_other_labels(mails):
    (group,) = dedup.exact_duplicates(extract.visible_text(mails)).collect()
    assert (group.first_doc, group.n_docs) == ("base", 2)


def test_near_copies_of_mailings(mails):
    found = dedup.near_duplicates(extract.visible_text(mails), 0.5).collect()
    assert sorted((r.a, r.b) for r in found) == [("base", "same_text"), ("base", "variant")]


@pytest.mark.parametrize("n", [1, 2, 3, 9, 20])
def test_families_follow_long_chains(spark, n):
    chain = [(i, i + 1) for i in range(n)] + [(100, 200), (100, 201), (200, 300)]
    family = dedup.linked_families(spark.createDataFrame(chain, "a long, b long"))
    assert sorted(map(tuple, family.select("doc_id", "family").collect())) == sorted(
        [(i, 0) for i in range(n + 1)] + [(100, 100), (200, 100), (201, 100), (300, 100)]
    )


def test_links_may_form_a_circle(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a long, b long")
    assert sorted(map(tuple, dedup.linked_families(links).collect())) == [(1, 1), (2, 1), (3, 1)]


def families_by_force(texts, threshold, k):
    sets = [shingle_set(t, k) for t in texts]
    family = list(range(len(texts)))

    def root(x):
        while family[x] != x:
            x = family[x]
        return x

    linked = set()
    for b, later in enumerate(sets):
        for a in range(b):
            if later and sets[a] and len(later & sets[a]) / len(later | sets[a]) >= threshold:
                linked |= {a, b}
                one, two = root(a), root(b)
                family[max(one, two)] = min(one, two)
    return sorted((x, root(x)) for x in linked)


@pytest.mark.parametrize("seed, threshold", [(1, 0.5), (2, 0.5), (3, 0.8), (4, 0.6)])
def test_families_join_all_links(spark, seed, threshold):
    texts = corpus(seed)
    got = dedup.version_family(frame(spark, texts), threshold)
    assert sorted(map(tuple, got.select("doc_id", "family").collect())) == families_by_force(texts, threshold, 5)


def test_a_document_like_a_later_one_only(spark):
    """The third text repeats the first and the second, which are unlike each other."""
    one, two = ([f"{x}{i}" for i in range(20)] for x in "ab")
    texts = [" ".join(one), " ".join(two), " ".join(one + two)]
    got = dedup.version_family(frame(spark, texts), 0.4)
    assert sorted(map(tuple, got.collect())) == [(0, 0), (1, 0), (2, 0)]


def test_similarity_of_given_pairs(spark):
    texts = frame(spark, ["a b c d e f", "A  b c d e x", "a b", "q r s t u"])
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3)], "a long, b long")
    got = dedup.similarity(texts, pairs).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1 / 3), (0, 3, 0.0)]


def test_no_links_no_families(spark):
    assert dedup.linked_families(spark.createDataFrame([], "a long, b long")).count() == 0
    assert dedup.version_family(frame(spark, ["a b c d e f", "g h i j k l"])).count() == 0


def test_differences_by_position(spark):
    texts = frame(spark, ["a\nb\nc", "a\nx\nc\nd", "a\nb\nc"])
    got = diff.revision_diff(texts, 0, 1).collect()
    assert sorted(map(tuple, got)) == [(1, "a", "b"), (1, "b", "x"), (3, "b", "d")]
    assert diff.revision_diff(texts, 0, 0).count() == 0
    assert diff.revision_diff(texts, 0, 2).count() == 0


def test_differences_wherever_they_stand(spark):
    texts = frame(spark, ["a\nb\nb", "b\na", "c\nc\na\n", ""])
    pairs = spark.createDataFrame([(0, 1), (0, 2), (3, 1)], "a long, b long")
    got = sorted(map(tuple, diff.line_changes(texts, pairs).collect()))
    assert got == [
        (0, 1, "b", 2, 1),
        (0, 2, "", 0, 1),
        (0, 2, "b", 2, 0),
        (0, 2, "c", 0, 2),
        (3, 1, "", 1, 0),
        (3, 1, "a", 0, 1),
        (3, 1, "b", 0, 1),
    ]


def test_differences_with_a_missing_document(spark):
    texts = frame(spark, ["a\nb"])
    pairs = spark.createDataFrame([(0, 9), (9, 0), (8, 9)], "a long, b long")
    lines = sorted(map(tuple, diff.revision_diffs(texts, pairs).collect()))
    assert lines == [(0, 9, 0, "a", "a"), (0, 9, 1, "a", "b"), (9, 0, 0, "b", "a"), (9, 0, 1, "b", "b")]
    assert sorted(map(tuple, diff.revision_diff(texts, 0, 9).collect())) == [(0, "a", "a"), (1, "a", "b")]
    changes = sorted(map(tuple, diff.line_changes(texts, pairs).collect()))
    assert changes == [(0, 9, "a", 1, 0), (0, 9, "b", 1, 0), (9, 0, "a", 0, 1), (9, 0, "b", 0, 1)]
