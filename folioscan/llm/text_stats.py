"""Statistics of whole texts, for rules and classifiers of quality."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from folioscan.llm.common import by_batch

WINDOW = 5
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = bytes(range(65, 91))

#: Counts, and shares in thousandths of words, characters or lines.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = ("symbols", "capitals", "exclaimed", "repeated", "dup_lines", "distinct", "word_length")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of five words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if found[window] > 1:
            covered += at + WINDOW - max(at, end)
            end = at + WINDOW
    return covered


def stats(text: str) -> tuple[int, ...]:
    """``COUNTS`` and ``SHARES`` of one text; all zero for a text without words."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    repeated = repeat_words(words)
    if not n:
        return (0, 0, 0, 0, 0, *[0] * len(SHARES))
    capitals = len(data) - len(data.translate(None, CAPITALS))
    return (
        n,
        chars,
        symbols,
        dup_lines,
        repeated,
        1000 * symbols // chars,
        1000 * capitals // chars,
        1000 * text.count("!") // n,
        1000 * repeated // n,
        1000 * dup_lines // len(lines),
        1000 * len(set(words)) // n,
        1000 * chars // n,
    )


def text_stats(documents: DataFrame, *kept: str, prefix: str = "") -> DataFrame:
    """The columns ``kept`` and the statistics of ``text``, named with ``prefix``."""
    named = [prefix + name for name in (*COUNTS, *SHARES)]
    given = documents.select(*kept, documents["text"].alias(f"{prefix}whole text"))
    schema = StructType([*given.schema.fields[:-1], *(StructField(name, LongType()) for name in named)])

    def compute(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [stats(text or "") for text in batch.column(len(kept)).to_pylist()]
        columns = [pa.array([row[i] for row in rows], pa.int64()) for i in range(len(named))]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *named])

    return by_batch(given, compute, schema)
