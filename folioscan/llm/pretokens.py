"""Cuts text into pieces that byte-level BPE encodes independently of their context.

Where no two characters of white space stand together, the pre-tokenizer joins a
space only to what follows it, and a line break to nothing. Such a text may be
cut before every space and around every line break. The pieces recur, so their
encodings can be kept.

Texts are cut in blocks, as flat arrays of bytes with the places where something
begins; only what the arrays cannot tell is left to the pattern.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

# Fixed value: the published split pattern of byte-level BPE.
SPLIT = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
SPACES_TOGETHER = re.compile(r"\s\s")
#: Beyond these, two versions of Unicode may class a character differently.
RECENT = re.compile(r"[^\u0000-ԯḀ-⁤]")
#: What a byte is to the pattern. The pattern itself cuts pieces with an odd one: an apostrophe, a
#: line break, or of a character beyond U+023F, up to where all versions of Unicode agree on letters.
REST, LETTER, DIGIT, MARK, SPACE, ODD = range(6)
KINDS = np.full(256, ODD, dtype=np.uint8)
KINDS[33:127] = MARK
KINDS[48:58] = DIGIT
KINDS[65:91] = KINDS[97:123] = KINDS[0xC3:0xC9] = LETTER
KINDS[0x80:0xC0] = REST
KINDS[32] = SPACE
KINDS[39] = ODD
#: Bytes of which white space may consist, other than a space or a line break.
OTHER_SPACE = np.zeros(256, dtype=bool)
OTHER_SPACE[[9, 11, 12, 13, 28, 29, 30, 31, 0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Runs gathered at a time; their indices need more memory than what is gathered.
GATHERED = 1 << 18


def split(text: str, library: Callable | None = None) -> list[str]:
    """The pre-tokens of a text; ``library`` splits texts with unusual characters."""
    if library is not None and RECENT.search(text):
        return [text[a:b] for _, (a, b) in library(text)]
    return SPLIT.findall(text)


def pieces(text: str, library: Callable | None = None) -> list[str]:
    """Pieces, some of them empty, whose encodings in order are the encoding of ``text``."""
    if SPACES_TOGETHER.search(text) or "\0" in text:
        return split(text, library)
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


def encoded_lengths(texts: list[str]) -> list[int]:
    return [len(text.encode("utf-8", "surrogatepass")) for text in texts]


def cut_up(texts: list[str], specials: list[str], cut: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where their pieces begin and the last one ends, and each text's first piece.

    ``cut`` gives the pieces of a text in which white space stands together, or a special string.
    """
    parts = [text.encode("utf-8", "surrogatepass") for text in texts]
    edges = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(part) for part in parts], out=edges[1:])
    joined = b"".join(parts)
    data = np.frombuffer(joined, dtype=np.uint8)
    begins = np.zeros(len(data) + 1, dtype=bool)
    breaks = data == 10
    white = breaks | (data == 32)
    begins[:-1] = white
    begins[1:] |= breaks
    begins[edges] = True
    together = white[1:] & white[:-1]
    inner = edges[(edges > 0) & (edges < len(data))]
    together[inner - 1] = False

    def having(mask: np.ndarray) -> set[int]:
        return set(np.searchsorted(edges, np.flatnonzero(mask), side="right").tolist())

    awkward = {i - 1 for i in having(together)}
    awkward |= {i - 1 for i in having(OTHER_SPACE[data]) if SPACES_TOGETHER.search(texts[i - 1])}
    for special in specials:
        if special.encode() in joined:
            awkward |= {i for i, text in enumerate(texts) if special in text}
    for i in awkward:
        begins[edges[i] : edges[i + 1]] = False
        ends = edges[i] + np.cumsum(encoded_lengths(cut(texts[i])))
        begins[edges[i]] = True
        begins[ends] = True
    begun = np.flatnonzero(begins)
    return data, begun, np.searchsorted(begun, edges)


def split_up(data: np.ndarray, begun: np.ndarray, library: Callable | None = None) -> np.ndarray:
    """Where the pre-tokens of pieces begin, and the last one ends; ``begun`` is as ``cut_up`` gives it."""
    kinds = KINDS[data]
    rest = np.flatnonzero(kinds == REST)
    kinds[rest] = kinds[rest - 1]
    # Third bytes are odd, and so are the signs of multiplication and division, which are no letters.
    kinds[kinds == REST] = ODD
    signs = (data[rest - 1] == 0xC3) & ((data[rest] == 0x97) | (data[rest] == 0xB7))
    kinds[rest[signs]] = ODD
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[begun] = True
    begun_at = begins[:-1].copy()
    begins[1:-1] |= (kinds[1:] != kinds[:-1]) & (kinds[:-1] != SPACE)
    # A space inside a piece follows other white space.
    odd = (kinds == ODD) | ((kinds == SPACE) & ~begun_at)
    for i in np.unique(np.searchsorted(begun, np.flatnonzero(odd), side="right") - 1).tolist():
        a, b = int(begun[i]), int(begun[i + 1])
        tokens = split(data[a:b].tobytes().decode("utf-8", "surrogatepass"), library)
        begins[a:b] = False
        begins[a] = True
        begins[a + np.cumsum(encoded_lengths(tokens))] = True
    return np.flatnonzero(begins)


def strings(data: np.ndarray, begun: np.ndarray) -> pa.BinaryArray:
    """What lies between the places, as Arrow's strings of bytes."""
    offsets = pa.py_buffer(begun.astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(begun) - 1, [None, offsets, pa.py_buffer(data)])


def flat(found: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some strings, and where they begin and the last one ends."""
    _, offsets, data = found.buffers()
    begun = np.frombuffer(offsets, dtype=np.int32)[found.offset : found.offset + len(found) + 1]
    return np.frombuffer(data, dtype=np.uint8)[begun[0] : begun[-1]], (begun - begun[0]).astype(np.int64)


def gather(values: np.ndarray, ends: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Of values in runs, the runs that are wanted one after another."""
    found = [values[:0]]
    for at in range(0, len(wanted), GATHERED):
        some = wanted[at : at + GATHERED]
        many = sizes[some]
        upto = np.cumsum(many)
        found.append(values[np.repeat(ends[some] - upto, many) + np.arange(upto[-1])])
    return np.concatenate(found)


class Table:
    """The ids of pieces, at most ``most`` of them after each block, so that a task's memory is bounded.

    When there are more, half of ``most`` stay, those that were looked up most often, of late above
    all, and always the ``fixed`` ones. All that is kept is hashed with each block, so that what
    rarely recurs costs more to keep than to encode again.
    """

    def __init__(self, fixed: dict[bytes, int], most: int = 200_000):
        self.fixed, self.most = fixed, most
        self.clear()

    def __len__(self) -> int:
        return len(self.names)

    def clear(self) -> None:
        self.names = pa.array(list(self.fixed), pa.binary())
        self.ids = np.array(list(self.fixed.values()), dtype="<u4")
        self.sizes = np.ones(len(self.fixed), dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        self.uses = np.zeros(len(self.fixed))

    def find(self, wanted: pa.BinaryArray) -> tuple[np.ndarray, pa.BinaryArray]:
        """Places of the wanted strings, and those the table lacks: their places follow the table's."""
        n = len(self.names)
        found = pa.concat_arrays([self.names, wanted]).dictionary_encode()
        return found.indices.to_numpy()[n:], found.dictionary[n:]

    def add(self, names: pa.BinaryArray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, names])
        self.ids = np.concatenate([self.ids, ids])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ends = np.cumsum(self.sizes)
        self.uses = np.append(self.uses, np.zeros(len(sizes)))

    def of(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places one after another."""
        return gather(self.ids, self.ends, self.sizes, places)

    def make_room(self, used: np.ndarray) -> None:
        """Count a block's places, and give up what is too much."""
        self.uses = self.uses / 2 + np.bincount(used, minlength=len(self))
        if len(self) <= self.most:
            return
        self.uses[: len(self.fixed)] = np.inf
        self.keep(np.sort(np.argsort(-self.uses, kind="stable")[: max(self.most // 2, len(self.fixed))]))
        self.uses[: len(self.fixed)] = 0

    def keep(self, places: np.ndarray) -> None:
        """Give up all but what is at some places, which are in order."""
        self.names, self.ids = self.names.take(pa.array(places)), self.of(places)
        self.sizes, self.uses = self.sizes[places], self.uses[places]
        self.ends = np.cumsum(self.sizes)


class Kept(dict):
    """Results by piece, at most ``most`` of them, so that a task's memory is bounded.

    When half of these are held, they become the older ones, which are given up at the next
    time; what is asked for in between is taken over, so that pieces that recur stay.
    """

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most
        self.older: dict = {}

    def make_room(self, n: int) -> bool:
        """Whether all was given up to make room for ``n`` more."""
        full = len(self) + n > self.most
        if full:
            self.clear()
        return full

    def lacking(self, wanted: set) -> list:
        """The wanted pieces that have no result; all others are held afterwards."""
        if len(self) + len(wanted) > self.most // 2:
            self.older = dict(self)
            super().clear()
        found, older = [], self.older.get
        for piece in wanted:
            if piece not in self:
                result = older(piece)
                if result is None:
                    found.append(piece)
                else:
                    self[piece] = result
        return found

    def clear(self) -> None:
        super().clear()
        self.older = {}
