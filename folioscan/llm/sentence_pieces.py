"""SentencePiece encoding and decoding for vocabularies of merges.

The symbols of a text are at first its characters. An agenda holds every pair of
neighbours that together are a piece of the vocabulary, best score first and then
leftmost; the first is merged, and the pairs that its neighbours form with the new
symbol join the agenda. Characters outside the vocabulary become the pieces of their bytes.

No piece holds a space after another character (checked when a vocabulary is read),
so nothing merges across the start of a word: a block's distinct words are looked up
together, and the ids of those that recur are kept. New words are merged together too:
their agendas are the columns of an array, and each round takes the first entry of
every agenda. The few long ones have an agenda of their own, as a heap.

What is worked out is checked against the sentencepiece library, id for id and text for
text: every word that is new to a worker, and the whole of every text that is not simply
cut at single spaces and line breaks. ``as_library`` tells the outcome of each row. Null and empty texts have no
ids and decode to an empty text. Rows are treated one by one: repeated rows, rows
without an id and extra columns change nothing, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from folioscan.llm.common import by_batch, texts_of
from folioscan.llm.pretokens import Table, flat, gather, strings

#: What stands for a space.
SPACE = "▁"
#: Words of more bytes are not kept: they hardly recur, and what is kept must be bounded.
KEPT_LENGTH = 64
#: Words that a Python worker keeps.
KEPT_WORDS = 200_000
#: Words that are checked in one call.
CHECKED = 1_000
#: Words of up to as many characters are merged together, longer ones by a heap.
SHORT = 32
#: Words decoded at a time, and words merged at a time: their arrays should fit the processor's cache.
DECODED, MERGED = 1 << 15, 1 << 12
#: A cost beyond those of all pairs.
NEVER = 1 << 30
#: A symbol that has been merged into the one before.
GONE = -1
WORDS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, as_library boolean"


class Words(Table):
    """The ids of words, none of which is long."""

    def __iter__(self) -> Iterator[bytes]:
        return iter(self.names.to_pylist())

    def make_room(self, used: np.ndarray) -> None:
        short = pc.less_equal(pc.binary_length(self.names), KEPT_LENGTH).to_numpy(zero_copy_only=False)
        if short.all():
            super().make_room(used)
            return
        moved = np.cumsum(short) - 1
        self.keep(np.flatnonzero(short))
        super().make_room(moved[used[short[used]]])


class Pairs:
    """Which symbols merge to which piece, and at what cost.

    Symbols are the ids of pieces, and numbers beyond those for other characters.
    """

    def __init__(self, ids: dict[str, int], costs: dict[str, float], width: int):
        alone = sorted({c for piece in ids for c in piece} - ids.keys())
        of = ids | {c: width + i for i, c in enumerate(alone)}
        #: A character of which no piece is made.
        self.other = width + len(alone)
        self.width = self.other + 1
        characters = {ord(c): i for c, i in of.items() if len(c) == 1}
        self.of_character = np.full(max(characters, default=0) + 2, self.other, dtype=np.int32)
        self.of_character[list(characters)] = list(characters.values())
        made = {}
        for piece, i in ids.items():
            for at in range(1, len(piece)):
                left, right = of.get(piece[:at]), of.get(piece[at:])
                if left is not None and right is not None:
                    made[left * self.width + right] = i
        keys = np.array(sorted(made), dtype=np.int64)
        #: The last key is none: it stands for all that are not among the others.
        self.keys = np.append(keys, np.iinfo(np.int64).max)
        self.made = np.array([made[key] for key in keys.tolist()] + [self.other], dtype=np.int32)
        #: The place of a key by its hash, and hashes that several keys have: those are searched for.
        bits = max(4 + len(keys).bit_length(), 8)
        self.shift = np.uint64(64 - bits)
        self.place = np.full(1 << bits, len(keys), dtype=np.int32)
        hashes = self.hashes(keys)
        self.place[hashes] = np.arange(len(keys))
        shared, times = np.unique(hashes, return_counts=True)
        self.place[shared[times > 1]] = -1
        #: Costs in order, the same for pieces of the same cost, with room for a place.
        self.costs = np.full(self.width, NEVER, dtype=np.int32)
        _, order = np.unique([costs[piece] for piece in ids], return_inverse=True)
        self.costs[list(ids.values())] = order * SHORT
        inner = {of[a] * self.width + of[b] for piece in ids for a, b in zip(piece, piece[1:])}
        self.inner = np.array(sorted(inner), dtype=np.int64)

    def symbols(self, characters: np.ndarray) -> np.ndarray:
        return self.of_character[np.minimum(characters, len(self.of_character) - 1)]

    def inside(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether neighbouring characters stand together in some piece; no merge spans a place between others."""
        return np.isin(left * np.int64(self.width) + right, self.inner)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, or ``other``."""
        key = left * np.int64(self.width) + right
        at = self.place[self.hashes(key)]
        shared = np.flatnonzero(at < 0)
        at[shared] = np.searchsorted(self.keys, key[shared])
        return np.where(self.keys[at] == key, self.made[at], np.int32(self.other))

    def hashes(self, key: np.ndarray) -> np.ndarray:
        # Fixed value: 2**64 divided by the golden ratio, the multiplier of Fibonacci hashing.
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def merge(
        self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is left of the symbols of each word, the place of each of these, and how many a word has.

        The words' lengths are in order, of ``SHORT`` at most. An array has a column for each word, a
        row for each place, and one more row that stands for what is beyond the ends. A round merges
        the first pair of each word's agenda: costs have room for a place, so the least is leftmost.
        """
        n, high = len(starts), int(lengths[-1])
        rows = np.arange(high + 1)[:, None]
        places = starts + rows
        used = rows < lengths
        now = np.where(used, symbols[np.minimum(places, len(symbols) - 1)], np.int32(self.other))
        made = np.full(now.shape, self.other, dtype=np.int32)
        two = used[1:]
        made[:-1][two] = self.of(now[:-1][two], now[1:][two])
        agenda = self.costs[made]
        agenda += rows.astype(np.int32) * (agenda < NEVER)
        after, before = np.empty(now.shape, dtype=np.int32), np.empty(now.shape, dtype=np.int32)
        after[:], before[:] = rows + 1, rows - 1
        before[0] = high
        cells = [array.reshape(-1) for array in (now, made, agenda, after, before)]
        at_now, at_made, at_agenda, at_after, at_before = cells
        while True:
            best = agenda.min(axis=0)
            column = np.flatnonzero(best < NEVER)
            if not len(column):
                break
            place = best[column] % SHORT
            left = place * n + column
            right = at_after[left] * n + column
            beyond = at_after[right]
            merged = at_made[left]
            at_now[left], at_now[right], at_agenda[right] = merged, GONE, NEVER
            at_after[left] = beyond
            beyond = beyond * n + column
            at_before[beyond] = place
            former = at_before[left]
            prior = former * n + column
            for cell, row, piece in (
                (left, place, self.of(merged, at_now[beyond])),
                (prior, former, self.of(at_now[prior], merged)),
            ):
                at_made[cell] = piece
                cost = self.costs[piece]
                at_agenda[cell] = np.where(cost < NEVER, cost + row, NEVER)
        kept = (used & (now != GONE)).T
        return now.T[kept], places.T[kept], kept.sum(axis=1)


class Vocabulary:
    """A merge-type vocabulary: costs of pieces (their scores below zero), and what each id says."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.require(model.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE, "merges")
        rules = model.normalizer_spec
        self.require(not (rules.precompiled_charsmap or rules.remove_extra_whitespaces), "texts as they are")
        self.require(model.trainer_spec.byte_fallback, "bytes for unknown characters")
        self.require(not model.trainer_spec.treat_whitespace_as_suffix, "spaces before words")
        self.prefix = SPACE if rules.add_dummy_prefix else ""
        self.ids: dict[str, int] = {}
        self.costs: dict[str, float] = {}
        self.of_byte: dict[int, int] = {}
        self.said: list[bytes] = []
        self.byte_ids: set[int] = set()
        for i, piece in enumerate(model.pieces):
            self.require(piece.type not in (kinds.USER_DEFINED, kinds.UNUSED), "pieces that merges make")
            if piece.type == kinds.NORMAL:
                self.ids[piece.piece] = i
                self.costs[piece.piece] = -piece.score
                self.said.append(piece.piece.replace(SPACE, " ").encode())
            elif piece.type == kinds.BYTE:
                self.of_byte[int(piece.piece[3:-1], 16)] = i
                self.byte_ids.add(i)
                self.said.append(bytes([int(piece.piece[3:-1], 16)]))
            else:
                unknown = piece.type == kinds.UNKNOWN
                self.said.append(model.trainer_spec.unk_surface.encode() if unknown else b"")
        self.require(not any(SPACE in piece.lstrip(SPACE) for piece in self.ids), "spaces before words only")
        self.require(not any("\n" in piece for piece in self.ids if len(piece) > 1), "line breaks on their own")
        self.pairs = Pairs(self.ids, self.costs, len(self.said))
        self.bytes_ids = np.array([self.of_byte.get(b, 0) for b in range(256)], dtype=np.int32)
        self.spoken = pa.array(self.said, pa.binary())
        #: Each id as a decimal number with a comma behind it.
        self.decimals = pa.array([f"{i},".encode() for i in range(len(self.said))], pa.binary())
        self.kept = Words({}, KEPT_WORDS)
        #: What the library says before a word that stands after a line break.
        self.before = self.library.encode("\n")
        #: Words that have not been checked yet, with their ids and how many each has.
        self.fresh: list[tuple[pa.BinaryArray, np.ndarray, np.ndarray]] = []
        #: Words that the library encodes or decodes otherwise; there should be none.
        self.wrong: set[str] = set()

    @staticmethod
    def require(holds: bool, what: str) -> None:
        if not holds:
            raise ValueError(f"this vocabulary is not one of {what}")

    def merged(self, word: str) -> list[str]:
        """The pieces of a long word: its agenda is a heap, with entries that may be out of date."""
        costs = self.costs
        n = len(word)
        # Symbols by the place of their first character; beyond the end there is none.
        symbols: list[str | None] = [*word, None]
        before, after = list(range(-1, n)), list(range(1, n + 2))
        agenda = [(costs[pair], i, pair) for i, pair in enumerate(map(add, word, word[1:])) if pair in costs]
        heapify(agenda)
        while agenda:
            _, left, pair = heappop(agenda)
            one, right = symbols[left], after[left]
            other = symbols[right]
            # A side that has been merged since gives another text, or none.
            if one is None or other is None or len(one) + len(other) != len(pair):
                continue
            symbols[left], symbols[right] = pair, None
            right = after[left] = after[right]
            if right < n:
                before[right] = left
                both = pair + symbols[right]
                if both in costs:
                    heappush(agenda, (costs[both], left, both))
            left = before[left]
            if left >= 0:
                both = symbols[left] + pair
                if both in costs:
                    heappush(agenda, (costs[both], left, both))
        return [symbol for symbol in symbols if symbol is not None]

    def ids_of_part(self, part: str) -> list[int]:
        found: list[int] = []
        for piece in self.merged(part):
            known = self.ids.get(piece)
            found += [known] if known is not None else [self.of_byte[b] for b in piece.encode()]
        return found

    def ids_of_words(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and the number of each."""
        ids, sizes = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for at in range(0, len(words), DECODED):
            for found, to in zip(self._ids_of_some(words[at : at + DECODED]), (ids, sizes)):
                to.append(found)
        return np.concatenate(ids), np.concatenate(sizes)

    def _ids_of_some(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        data, begun = flat(words)
        text = data.tobytes().decode().replace(" ", SPACE)
        symbols = self.pairs.symbols(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"))
        # Where each character's bytes begin, each word's characters, and each part's.
        led = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        starts = np.searchsorted(led, begun)
        parts = self._parts(symbols, starts)
        lengths = np.diff(parts)
        order = np.argsort(lengths, kind="stable")
        short = np.searchsorted(lengths[order], SHORT, side="right")
        ids, sizes = [np.zeros(0, dtype="<u4")], [np.zeros(0, dtype=np.int64)]
        for at in range(0, short, MERGED):
            some = order[at : min(at + MERGED, short)]
            merged, places, many = self.pairs.merge(symbols, parts[some], lengths[some])
            merged, many = self._by_bytes(merged, places, many, data, led)
            ids.append(merged.astype("<u4"))
            sizes.append(many)
        for i in order[short:].tolist():
            ids.append(np.array(self.ids_of_part(text[parts[i] : parts[i + 1]]), dtype="<u4"))
            sizes.append(np.array([len(ids[-1])]))
        found, many = np.concatenate(ids), np.concatenate(sizes)
        back = np.argsort(order, kind="stable")
        of_parts = gather(found, np.cumsum(many), many, back)
        return of_parts, np.add.reduceat(many[back], np.searchsorted(parts, starts[:-1]))

    def _parts(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where words begin, and long ones also between neighbours that stand together in no piece."""
        long = np.repeat(np.diff(starts) > SHORT, np.diff(starts))
        at = np.flatnonzero(long[1:]) + 1
        seams = at[~self.pairs.inside(symbols[at - 1], symbols[at])]
        return np.union1d(starts, seams) if len(seams) else starts

    def _by_bytes(self, merged, places, many, data, led) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the number of each part's: characters that are no piece become the ids of their bytes."""
        unknown = merged >= len(self.said)
        if not unknown.any():
            return merged, many
        at = places[unknown]
        sizes = np.ones(len(merged), dtype=np.int64)
        sizes[unknown] = led[at + 1] - led[at]
        found = np.repeat(merged, sizes)
        # Bytes of each unknown character, one after another.
        size = sizes[unknown]
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        found[np.repeat(unknown, sizes)] = self.bytes_ids[data[np.repeat(led[at], size) + inside]]
        return found, np.add.reduceat(sizes, np.cumsum(many) - many)

    def check(self) -> None:
        """Compare the words of a batch with the library, which reads them line by line."""
        for words, ids, sizes in self.fresh:
            ends = np.append(0, np.cumsum(sizes))
            for at in range(0, len(words), CHECKED):
                upto = min(at + CHECKED, len(words))
                some, of_some = words[at:upto].to_pylist(), ids[ends[at] : ends[upto]]
                if self._agrees(some, of_some, ends[at:upto] - ends[at]):
                    continue
                for i, word in enumerate(some, at):
                    if not self._agrees([word], ids[ends[i] : ends[i + 1]], np.zeros(1, dtype=np.int64)):
                        self.wrong.add(word.decode().replace(" ", SPACE))
        self.fresh = []

    def _agrees(self, some: list[bytes], of_some: np.ndarray, starts: np.ndarray) -> bool:
        said = (b"\n" + b"\n".join(some)).decode()
        *first, line = self.before
        ids = first + np.insert(of_some, starts, line).tolist()
        return self.library.encode(said) == ids and self.library.decode(ids) == said

    def is_plain(self, text: str) -> bool:
        """Whether a text is cut at single spaces and line breaks only."""
        return bool(self.prefix) and not ("  " in text or text[:1] == " " or SPACE in text or "\0" in text)

    def as_library(self, text: str, ids: np.ndarray, decoded: str) -> bool:
        """Whether the library agrees: with the words of a plain text, or with the whole of another."""
        if self.wrong and not self.wrong.isdisjoint(self.words(text)):
            return False
        if self.is_plain(text):
            return decoded == text
        found = ids.tolist()
        return found == self.library.encode(text) and decoded == self.library.decode(found)

    def words(self, text: str) -> list[str]:
        """Parts of a text that no piece spans."""
        return WORDS.findall(self.prefix + text.replace(" ", SPACE)) if text else []

    def cut_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all texts, where their words begin and the last one ends, and each text's first word."""
        prefix = self.prefix.replace(SPACE, " ")
        parts = [(prefix + text.replace(SPACE, " ")).encode() if text else b"" for text in texts]
        edges = np.append(0, np.cumsum([len(part) for part in parts], dtype=np.int64))
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        begins = np.zeros(len(data) + 1, dtype=bool)
        spaces, breaks = data == 32, data == 10
        begins[:-1] = spaces | breaks
        begins[1:-1] &= ~(spaces[1:] & spaces[:-1])
        begins[1:] |= breaks
        begins[edges] = True
        begun = np.flatnonzero(begins)
        return data, begun, np.searchsorted(begun, edges)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts one after another, and where each text's begin and the last one's end."""
        data, begun, edges = self.cut_up(texts)
        if not len(data):
            return np.zeros(0, dtype="<u4"), np.zeros(len(edges), dtype=np.int64)
        places, fresh = self.kept.find(strings(data, begun))
        if len(fresh):
            ids, sizes = self.ids_of_words(fresh)
            self.kept.add(fresh, sizes, ids)
            self.fresh.append((fresh, ids, sizes))
        found = self.kept.of(places)
        ends = np.append(0, np.cumsum(self.kept.sizes[places]))[edges]
        self.kept.make_room(places)
        return found, ends

    def encode(self, text: str) -> list[int]:
        """The ids of a whole text."""
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids that ``encode_all`` gives."""
        said, begun = spelled(self.spoken, ids, ends)
        found = []
        for i, (start, end) in enumerate(zip(begun, begun[1:])):
            first = int(ids[ends[i]]) if start < end else None
            if first is not None and first not in self.byte_ids:
                start += bool(self.prefix) and self.said[first][:1] == b" "
            try:
                found.append(said[start:end].decode())
            except UnicodeDecodeError:
                found.append(self.decode(ids[ends[i] : ends[i + 1]].tolist()))
        return found

    def id_digests(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The digest of each text's ids as decimal numbers joined by commas."""
        shown, begun = spelled(self.decimals, ids, ends)
        return [hashlib.sha256(shown[a : max(a, b - 1)]).hexdigest() for a, b in zip(begun, begun[1:])]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of any ids; one space that the encoding puts in front is taken away."""
        ids = list(ids)
        said = list(map(self.said.__getitem__, ids))
        if self.prefix:
            first = next((i for i, part in enumerate(said) if part), None)
            if first is not None and ids[first] not in self.byte_ids and said[first][:1] == b" ":
                unknown = self.library.unk_id() == ids[first]
                said[first] = said[first] if unknown else said[first][1:]
        if all(said):
            try:
                return b"".join(said).decode()
            except UnicodeDecodeError:
                pass
        # A piece that says nothing still ends a run of bytes.
        return "".join(self._lenient(ids, said))

    def _lenient(self, ids: list[int], said: list[bytes]) -> Iterator[str]:
        """Parts of a text in which some bytes are no character: each of them is a mark."""
        run = b""
        for i, part in zip(ids, said):
            if i in self.byte_ids:
                run += part
            else:
                yield from characters(run)
                run = b""
                yield part.decode()
        yield from characters(run)


def spelled(names: pa.BinaryArray, ids: np.ndarray, ends: np.ndarray) -> tuple[bytes, list[int]]:
    """The names of all ids put together, and where those of each text begin and the last one's end."""
    if not len(ids):
        return b"", [0] * len(ends)
    data, begun = flat(names.take(pa.array(ids)))
    return data.tobytes(), begun[ends].tolist()


def characters(run: bytes) -> Iterator[str]:
    """The characters of a run of bytes; a byte that belongs to none is U+FFFD."""
    at = 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                yield run[at : at + size].decode()
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            yield "�"
            at += 1


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each file and Python worker."""
    return Vocabulary(path)


def encoded(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids, decoded`` of every whole text.

    ``path`` names a merge-type sentencepiece model that every executor has.
    """

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = vocabulary(path)
        ids, ends = known.encode_all(texts_of(batch))
        known.fresh = []
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())),
                pa.array(known.decode_all(ids, ends), pa.string()),
            ],
            ["doc_id", "ids", "decoded"],
        )

    return by_batch(documents.select("doc_id", "text"), compute, "doc_id long, ids array<int>, decoded string")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def digests(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, as_library`` of every whole text.

    The ids are hashed as decimal numbers joined by commas. ``as_library`` says that
    ids and decoded text equal those of the library.
    """

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = vocabulary(path)
        texts = texts_of(batch)
        ids, ends = known.encode_all(texts)
        known.check()
        shown = zip(texts, known.id_digests(ids, ends), known.decode_all(ids, ends))
        rows: list[tuple] = []
        for (text, digest, decoded), start, end in zip(shown, ends.tolist(), ends[1:].tolist()):
            same = known.as_library(text, ids[start:end], decoded)
            rows.append((end - start, digest, sha256(decoded), same))
        columns = list(zip(*rows)) if rows else [()] * 4
        kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "as_library"],
        )

    return by_batch(documents.select("doc_id", "text"), compute, DIGESTS)
