"""Similarity join of word shingles under several global orders.

Two documents link when the Jaccard similarity of their sets of word shingles, ``SIZE``
words unless asked otherwise, is at least ``share`` hundredths, by default ``SHARE``. Linked sets share tokens among the first ones under
*any* order of all tokens. The filters of several orders are intersected before a
pair is verified:

1. By hash: the first tokens of a set must be in other sets too. Sets that share
   too few of them have no link and go no further.
2. By frequency, rarest first, over the remaining sets: a pair must share one of the
   first tokens, and from its place on enough tokens must be left on both sides.
   A set with too many tokens of its own has no link either.
3. By two more hashes: the pair must share first tokens under each of them.

Pairs are not made from all sets of a token. First every set is compared with the
one of its token's sets that has fewest tokens of its own, the likely original.
These links give classes; only pairs across different classes are made afterwards,
so that a group of copies costs about its size. No link that joins two classes is
lost, because every such pair passes all filters.

A document without words has no shingles and no links. Documents with the same set
are one node, which carries the least of their ids; rows without an id count as
members, but name no component unless they are alone, when it is null. Repeated
rows are equal sets. Null text is empty. An empty table gives an empty result;
further columns are ignored. Sets and nodes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan.llm.common import by_batch, slices, texts_of
from folioscan.operators.components import components
from folioscan.llm.shingles import mixed, shingles
from folioscan.session import staged

SIZE = 4
#: Least similarity in hundredths.
SHARE = 85
#: Entries of the first order that a task holds before it sends them on.
HELD = 1_000_000
#: Entries that one bucket gets, about.
BUCKET = 5_000


def node_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def needed(n: int | np.ndarray, share: int = SHARE) -> int | np.ndarray:
    """Tokens of a set of ``n`` that a linked set holds at least."""
    return -(-share * n // 100)


def tested(n: int) -> int:
    """Shared tokens that the first order asks for beyond what may differ."""
    return max(1, n // 10)


def may_differ(n: int, share: int = SHARE) -> bool:
    """Whether a set of ``n`` tokens can link to a set unlike it."""
    return 100 * n >= share * (n + 1)


def first_tokens(tokens: np.ndarray, salt: int, share: int = SHARE) -> np.ndarray:
    """Hashes of the tokens of which a linked set has one, by the order ``salt``."""
    n = len(tokens)
    ordered = np.sort(mixed(tokens, salt))[: n - needed(n, share) + 1]
    return (ordered >> np.uint64(32)).astype(np.uint32).view(np.int32)


def nodes(documents: DataFrame, size: int) -> DataFrame:
    """``doc_id, node, n``: the set of every document; no node without words."""

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(text, size) for text in texts_of(batch)]
        columns = [
            batch.column("doc_id"),
            pa.array([node_of(s) if len(s) else None for s in found], pa.int64()),
            pa.array([len(s) for s in found], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "node", "n"])

    return by_batch(documents.select("doc_id", "text"), compute, "doc_id long, node long, n long")


class Outbox:
    """Tokens of sets, by bucket. Tokens that several sets of the task have are settled at once.

    A settled token is sent on once, as node 0, so that other tasks learn of it:
    however many sets have a token, a bucket gets at most one entry from each outbox.
    """

    def __init__(self, n_buckets: int):
        self.n_buckets = n_buckets
        self.tokens: list[np.ndarray] = []
        self.nodes: list[int] = []
        self.held = 0
        self.seen: set[int] = set()

    def add(self, tokens: np.ndarray, node: int) -> None:
        if node not in self.seen:
            self.seen.add(node)
            self.tokens.append(tokens)
            self.nodes.append(node)
            self.held += len(tokens)

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        sizes = [len(t) for t in self.tokens]
        tokens = np.concatenate(self.tokens)
        owner = np.repeat(np.array(self.nodes, dtype=np.int64), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        often = np.diff(np.append(starts, len(tokens)))
        settled = np.repeat(often > 1, often)
        known, counts = np.unique(owner[settled], return_counts=True)
        tokens, owner = tokens[starts], np.where(often > 1, 0, owner[starts])
        bucket = (tokens >> np.uint64(32)) * np.uint64(self.n_buckets) >> np.uint64(32)
        # Tokens are in order, so buckets are: only those that hold some are visited.
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist()
        rows = [
            (int(bucket[a]), tokens[a:b].tobytes(), owner[a:b].tobytes())
            for a, b in zip(edges, [*edges[1:], len(tokens)])
        ]
        if len(known):
            rows.append((-1 - int(known[0]) % self.n_buckets, counts.astype(np.int64).tobytes(), known.tobytes()))
        columns = zip(*rows)
        kinds = (pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "tokens", "nodes"]
        )
        self.tokens, self.nodes, self.held = [], [], 0
        self.seen.clear()


def settle(table: pa.Table) -> pa.Table:
    """``node, shared``: tokens of a bucket that more than one set has; below zero, counts as they are."""
    joined = lambda name, kind: np.concatenate(
        [np.frombuffer(x, dtype=kind) for x in table.column(name).to_pylist()]
    )
    owner = joined("nodes", np.int64)
    if table.column("bucket")[0].as_py() < 0:
        counts = joined("tokens", np.int64)
    else:
        tokens = joined("tokens", np.uint64)
        order = np.lexsort((owner, tokens))
        tokens, owner = tokens[order], owner[order]
        fresh = np.append(True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1]))
        tokens, owner = tokens[fresh], owner[fresh]
        starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        often = np.diff(np.append(starts, len(tokens)))
        owner = owner[np.repeat(often > 1, often) & (owner != 0)]
        owner, counts = np.unique(owner, return_counts=True)
    return pa.table({"node": pa.array(owner, pa.int64()), "shared": pa.array(counts, pa.int64())})


def shared_counts(sets: DataFrame, compute: Callable, n_entries: int) -> DataFrame:
    """``node, shared``: how many of the tokens that ``compute`` gives for a row others have too.

    ``compute`` maps a batch to pairs of node and tokens.
    """
    n_buckets = max(8, -(-n_entries // BUCKET))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outbox = Outbox(n_buckets)
        for batch in slices(batches):
            for node, tokens in compute(batch):
                outbox.add(tokens, node)
                if outbox.held >= HELD:
                    yield from outbox.send()
        yield from outbox.send()

    sent = sets.mapInArrow(run, "bucket int, tokens binary, nodes binary")
    counted = sent.groupBy("bucket").applyInArrow(settle, "node long, shared long")
    return counted.groupBy("node").agg(F.sum("shared").alias("shared"))


def candidates_by_hash(documents: DataFrame, sizes: DataFrame, size: int, share: int) -> DataFrame:
    """``node, n, doc_id`` of the sets that pass the first order; ``doc_id`` is one of each."""

    def compute(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for text in texts_of(batch):
            tokens = shingles(text, size)
            n = len(tokens)
            if n and may_differ(n, share):
                # A copy: a part of an array would keep the whole of it.
                yield node_of(tokens), tokens[: n - needed(n, share) + tested(n)].copy()

    total = sizes.agg(F.sum(F.col("n") / 4)).first()[0] or 0
    shared = shared_counts(documents.select("text"), compute, int(total))
    # The smallest set that may link is the least that the other side can ask for.
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * share / 100) / 10))
    return shared.join(sizes, "node").where(F.col("shared") >= least).select("node", "n", "doc_id")


def sets_of(documents: DataFrame, wanted: DataFrame, size: int, share: int) -> DataFrame:
    """``node, n, tokens, second, third``: the sets of wanted nodes, and their first tokens by two orders."""
    # Without the hint the plan would change with the size of the corpus: only a small
    # one's nodes fit a broadcast. The hash table is that of the few wanted nodes.
    chosen = wanted.select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).hint("shuffle_hash")
    texts = documents.join(chosen, documents["doc_id"].eqNullSafe(chosen["_id"])).select("text", "_node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The rows of an id are in one task, and so are repeated ones.
        seen: set[int] = set()
        for batch in slices(batches):
            rows = []
            for text, node in zip(texts_of(batch), batch.column("_node").to_pylist()):
                tokens = shingles(text, size) if node not in seen else ()
                if len(tokens) and node_of(tokens) == node:
                    seen.add(node)
                    second, third = (first_tokens(tokens, salt, share).tolist() for salt in (1, 2))
                    rows.append((node, len(tokens), tokens.view(np.int64).tolist(), second, third))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["node", "n", "tokens", "second", "third"]
            )

    schema = "node long, n long, tokens array<long>, second array<int>, third array<int>"
    return texts.mapInArrow(run, schema)


def with_enough_shared(sets: DataFrame, share: int) -> DataFrame:
    """The sets of whose tokens others have as many as a link needs."""

    def compute(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for node, tokens in zip(batch.column("node").to_pylist(), batch.column("tokens")):
            yield node, np.sort(tokens.values.to_numpy().view(np.uint64))

    total = sets.agg(F.sum("n")).first()[0] or 0
    shared = shared_counts(sets.select("node", "tokens"), compute, int(total))
    enough = shared.join(sets.select("node", "n"), "node").where(100 * F.col("shared") >= share * F.col("n"))
    return sets.join(enough.select("node").distinct(), "node", "left_semi")


def by_frequency(sets: DataFrame, share: int) -> DataFrame:
    """``token, node, n, left, own``: the first tokens of every set, rarest first.

    ``left`` counts the tokens from this one on that other sets have too, ``own``
    the thousandths of tokens that no other set has.
    """
    tokens = staged(sets.select("node", "n", F.explode("tokens").alias("token")), "tokens")
    often = staged(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often > 1"), "often")
    placed = tokens.join(often, "token")
    by_node = Window.partitionBy("node")
    ordered = placed.select(
        "token",
        "node",
        "n",
        F.count(F.lit(1)).over(by_node).alias("shared"),
        F.row_number().over(by_node.orderBy("often", "token")).alias("place"),
    )
    need = F.ceil(F.col("n") * share / 100)
    return ordered.where(F.col("place") <= F.col("shared") - need + 1).select(
        "token",
        "node",
        "n",
        (F.col("shared") - F.col("place") + 1).alias("left"),
        F.floor((F.col("n") - F.col("shared")) * 1000 / F.col("n")).alias("own"),
    )


def can_link(n: Column, left: Column, other_n: Column, other_left: Column, share: int) -> Column:
    """Whether enough tokens are left on both sides from a shared one on."""
    return (100 + share) * F.least(left, other_left) >= share * (n + other_n)


def hub_pairs(entries: DataFrame, share: int) -> DataFrame:
    """``a, b``: every set with the set of its token that has fewest tokens of its own."""
    hubs = staged(
        entries.groupBy("token")
        .agg(F.min(F.struct("own", "node", "n", "left")).alias("hub"), F.count(F.lit(1)).alias("of"))
        .where("of > 1")
        .select("token", "hub.*")
        .select(
            "token",
            F.col("node").alias("hub"),
            F.col("n").alias("hub_n"),
            F.col("left").alias("hub_left"),
        ),
        "hubs",
    )
    close = can_link(F.col("n"), F.col("left"), F.col("hub_n"), F.col("hub_left"), share)
    return (
        entries.join(hubs, "token")
        .where((F.col("node") != F.col("hub")) & close)
        .select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
        .distinct()
    )


def pairs_across(entries: DataFrame, roots: DataFrame, share: int) -> DataFrame:
    """``a, b``: pairs of a token's sets that are in different classes.

    A token's largest class is its home. Every set outside its token's home meets
    the token's other sets; sets at home do not meet one another.
    """
    classed = staged(
        entries.join(roots, "node", "left").select(
            "token", "node", "n", "left", F.coalesce("root", "node").alias("root")
        ),
        "classed",
    )
    sizes = classed.groupBy("token", "root").agg(F.count(F.lit(1)).alias("of"))
    homes = staged(
        sizes.groupBy("token")
        .agg(F.max(F.struct("of", F.col("root").alias("home"))).alias("most"), F.count(F.lit(1)).alias("classes"))
        .where("classes > 1")
        .select("token", F.col("most.home").alias("home")),
        "homes",
    )
    split = staged(classed.join(homes, "token"), "split")
    outside = split.where(F.col("root") != F.col("home")).select(
        "token",
        F.col("node").alias("x"),
        F.col("n").alias("x_n"),
        F.col("left").alias("x_left"),
        F.col("root").alias("x_root"),
    )
    close = can_link(F.col("n"), F.col("left"), F.col("x_n"), F.col("x_left"), share)
    once = (F.col("root") == F.col("home")) | (F.col("x") < F.col("node"))
    pairs = outside.join(split, (outside["token"] == split["token"]) & (F.col("root") != F.col("x_root")) & once & close)
    return pairs.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def in_all_orders(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that share first tokens under the second and the third order too."""
    orders = sets.select("node", "second", "third")
    one = orders.toDF("a", "a_second", "a_third")
    two = orders.toDF("b", "b_second", "b_third")
    return (
        pairs.join(one, "a")
        .join(two, "b")
        .where(F.arrays_overlap("a_second", "b_second") & F.arrays_overlap("a_third", "b_third"))
        .select("a", "b")
    )


def verified(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """The pairs that are similar enough."""
    tokens = sets.select("node", "tokens")
    both = pairs.join(tokens.toDF("a", "a_tokens"), "a").join(tokens.toDF("b", "b_tokens"), "b")

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        linked = []
        for one, two in zip(batch.column("a_tokens"), batch.column("b_tokens")):
            one, two = one.values.to_numpy(), two.values.to_numpy()
            shared = len(np.intersect1d(one, two, assume_unique=True))
            linked.append(100 * shared >= share * (len(one) + len(two) - shared))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return by_batch(both.select("a", "b", "a_tokens", "b_tokens"), compute, "a long, b long")


def links(documents: DataFrame, sizes: DataFrame, size: int, share: int) -> DataFrame:
    """``a, b``: links between nodes that join all linked ones."""
    wanted = staged(candidates_by_hash(documents, sizes, size, share), "wanted")
    all_sets = staged(sets_of(documents, wanted, size, share), "sets")
    sets = staged(with_enough_shared(all_sets, share), "sets")
    entries = staged(by_frequency(sets, share), "entries")
    met = staged(hub_pairs(entries, share), "pairs")
    to_hubs = staged(verified(in_all_orders(met, sets), sets, share), "links")
    across = pairs_across(entries, components(to_hubs), share).join(met, ["a", "b"], "left_anti")
    others = staged(verified(in_all_orders(across, sets), sets, share), "links")
    return to_hubs.unionAll(others)


def ngram_join(documents: DataFrame, size: int = SIZE, share: int = SHARE) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    documents = documents.select("doc_id", "text")
    found = staged(nodes(documents, size), "nodes")
    sizes = staged(
        found.where(F.col("node").isNotNull())
        .groupBy("node")
        .agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")),
        "sizes",
    )
    roots = components(links(documents, sizes, size, share))
    classed = sizes.join(roots, "node", "left").select(
        "node", "doc_id", F.coalesce("root", "node").alias("root")
    )
    least = classed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = staged(classed.join(least, "root").select("node", "component_id"), "components")
    return found.join(named, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(documents: DataFrame, size: int = SIZE, share: int = SHARE) -> DataFrame:
    """One document of each component, that of the least id, with all its columns.

    Of repeated rows one stays. Rows without an id stay, unless they are like one
    that has an id or another one without. Where an id stands for several texts,
    all of them stay if one does.
    """
    found = staged(ngram_join(documents, size, share).select("doc_id", "component_id"), "found")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    staying = found.where(stays).select("doc_id").distinct()
    going = staged(
        exclude(found.where(~stays).select("doc_id").distinct(), staying), "going"
    )
    several = staged(
        found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("of")).where("of > 1").select("doc_id"), "several"
    )
    left = exclude(documents, going)
    repeated = several.select(F.col("doc_id").alias("_id"))
    same = left["doc_id"].eqNullSafe(repeated["_id"])
    return exclude(left, several).unionAll(
        left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    )


def exclude(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is not among ``ids``; null equals null."""
    others = ids.select(F.col("doc_id").alias("_id"))
    return rows.join(others, rows["doc_id"].eqNullSafe(others["_id"]), "left_anti")
