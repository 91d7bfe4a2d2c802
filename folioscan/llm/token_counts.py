"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pieces, of which a block's distinct ones are cut into pre-tokens.
A batch of distinct pre-tokens is one flat array of symbols with the start of
each sequence beside it. Every round finds, for all sequences at once, the
adjacent pair of lowest rank, and merges all its places; a sequence without a
known pair is done, and its symbols are counted.

Null and empty texts have no bytes and no tokens. Special strings inside a text
are one token each. Rows are treated one by one, so repeated rows, extra columns
and any order of rows give the same counts; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folioscan.llm.common import by_batch, texts_of
from folioscan.llm.pretokens import Table, cut_up, flat, pieces, split_up, strings

NO_RANK = np.iinfo(np.int32).max
LIMIT = 512
#: Sequences merged at a time; the arrays of a round take many times their bytes.
MERGED = 1 << 15


class Merges:
    """A byte-level BPE vocabulary as arrays: symbols of bytes, and ranked pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocabulary = data["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"] if t["special"]}
        self.width = max(vocabulary.values()) + 1
        shown = byte_symbols()
        self.of_byte = np.array([vocabulary[shown[b]] for b in range(256)], dtype=np.int64)
        keys, ranks, made = [], [], []
        for rank, merge in enumerate(data["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            keys.append(vocabulary[left] * self.width + vocabulary[right])
            ranks.append(rank)
            made.append(vocabulary[left + right])
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks = np.array(ranks, dtype=np.int32)[order]
        self.made = np.array(made, dtype=np.int64)
        # Ranks of two bytes, which every sequence begins with.
        self.of_bytes = self.rank(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def encode(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all non-empty sequences one after another, and the number of each."""
        ids, sizes = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(starts) - 1, MERGED):
            some = starts[at : at + MERGED + 1]
            done: list[tuple[np.ndarray, np.ndarray]] = []
            sizes.append(self._run(data[some[0] : some[-1]], np.diff(some), done))
            owners = np.concatenate([owner for owner, _ in done])
            symbols = np.concatenate([symbol for _, symbol in done])
            ids.append(symbols[np.argsort(owners, kind="stable")].astype("<u4"))
        return np.concatenate(ids), np.concatenate(sizes)

    def _run(self, data: np.ndarray, sizes: np.ndarray, ended: list) -> np.ndarray:
        """Merge until no pair is known; what has ended is added to ``ended`` by sequence."""
        found = sizes.copy()
        active = np.arange(len(sizes))
        symbols = self.of_byte[data]
        ranks = self._all_ranks(data, sizes)
        while len(active):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(ranks, starts)
            done = best == NO_RANK
            if done.any():
                found[active[done]] = sizes[done]
                keep = np.repeat(~done, sizes)
                ended.append((np.repeat(active[done], sizes[done]), symbols[~keep]))
                symbols, ranks = symbols[keep], ranks[keep]
                active, sizes, best = active[~done], sizes[~done], best[~done]
                if not len(active):
                    break
            symbols, ranks, sizes = self._merge(symbols, ranks, sizes, best)
        return found

    def _all_ranks(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rank of the pair of bytes that starts at each place; none at the last of a sequence."""
        ranks = np.full(len(data), NO_RANK, dtype=np.int32)
        ranks[:-1] = self.of_bytes[data[:-1].astype(np.int32) * 256 + data[1:]]
        ranks[np.cumsum(sizes) - 1] = NO_RANK
        return ranks

    def _merge(self, symbols, ranks, sizes, best):
        """Merge every place of each sequence's best pair, the left one of overlapping places."""
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero(ranks == best[owner])
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (np.diff(at) > 1) | (owner[at][1:] != owner[at][:-1])
        run = np.flatnonzero(fresh)
        inside = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at = at[inside % 2 == 0]
        symbols[at] = self.made[ranks[at]]
        last = np.zeros(len(symbols), dtype=bool)
        last[np.cumsum(sizes) - 1] = True
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        sizes = sizes - np.bincount(owner[at], minlength=len(sizes))
        moved = np.cumsum(keep) - 1
        at = moved[at]
        symbols, ranks, last = symbols[keep], ranks[keep], last[keep]
        starts = np.zeros(len(symbols), dtype=bool)
        starts[np.cumsum(sizes) - sizes] = True
        self._refresh(symbols, ranks, last, at)
        self._refresh(symbols, ranks, last, at[~starts[at]] - 1)
        return symbols, ranks, sizes

    def _refresh(self, symbols, ranks, last, at) -> None:
        ranks[at] = NO_RANK
        at = at[~last[at]]
        ranks[at] = self.rank(symbols[at], symbols[at + 1])


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable}
    rest = [b for b in range(256) if b not in shown]
    return shown | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pieces:
    """Encodes texts by the distinct pieces of a block and keeps the ids of pieces that recur."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        self.library = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.kept = Table({special.encode(): n for special, n in self.merges.specials.items()})

    def segments(self, text: str) -> list[str]:
        """The parts between special strings, which stand between them as their own parts."""
        parts = [text]
        for special in self.merges.specials:
            if special in text:
                parts = [x for part in parts for x in self._cut(part, special)]
        return parts

    def _cut(self, part: str, special: str) -> list[str]:
        if part in self.merges.specials:
            return [part]
        first, *rest = part.split(special)
        return [first, *(x for after in rest for x in (special, after))]

    def pieces(self, text: str) -> list[str]:
        specials = self.merges.specials
        return [
            x for part in self.segments(text) for x in ([part] if part in specials else pieces(part, self.library))
        ]

    def learn(self, wanted: pa.BinaryArray) -> np.ndarray:
        """Add pieces that are not kept; returns their places."""
        data, begun = flat(wanted)
        cuts = split_up(data, begun, self.library)
        tokens, fresh = self.kept.find(strings(data, cuts))
        if len(fresh):
            data, starts = flat(fresh)
            ids, sizes = self.merges.encode(data, starts)
            self.kept.add(fresh, sizes, ids)
        # A piece of one pre-token is known by that; of others the ids are put together.
        first = np.searchsorted(cuts, begun)
        many = np.diff(first) > 1
        places = tokens[first[:-1]].astype(np.int64)
        places[many] = len(self.kept) + np.arange(np.count_nonzero(many))
        inside = tokens[np.repeat(many, np.diff(first))]
        sizes = np.add.reduceat(self.kept.sizes[tokens], first[:-1])[many]
        self.kept.add(wanted.filter(pa.array(many)), sizes, self.kept.of(inside))
        return places

    def all(self, texts: list[str], together: int = 1 << 22) -> list:
        """Results of many texts; about ``together`` characters are worked on at once."""
        found, block, size = [], [], 0
        for text in texts:
            block.append(text)
            size += len(text)
            if size >= together:
                found += self._block(block)
                block, size = [], 0
        return found + self._block(block)

    def _block(self, block: list[str]) -> list:
        data, begun, edges = cut_up(block, list(self.merges.specials), self.pieces)
        if not len(data):
            return self.results(np.zeros(0, dtype=np.int64), edges)
        places, fresh = self.kept.find(strings(data, begun))
        if len(fresh):
            known = len(self.kept)
            places = np.append(np.arange(known), self.learn(fresh))[places]
        found = self.results(places, edges)
        self.kept.make_room(places)
        return found

    def ends(self, places: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The number of tokens before each text, and of all."""
        return np.append(0, np.cumsum(self.kept.sizes[places]))[edges]

    def results(self, places: np.ndarray, edges: np.ndarray) -> list:
        raise NotImplementedError


class Counter(Pieces):
    """Numbers of tokens."""

    def results(self, places: np.ndarray, edges: np.ndarray) -> list[int]:
        return np.diff(self.ends(places, edges)).tolist()


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    """One counter for each vocabulary and Python worker."""
    return Counter(path)


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    ``path`` names a byte-level BPE file that every executor has.
    """

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch)
        counts = pa.array(counter(path).all(texts), pa.int64())
        sizes = pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
        over = pa.array([n > limit for n in counts.to_pylist()], pa.bool_())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), sizes, counts, over],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return by_batch(documents.select("doc_id", "text"), compute, schema)
