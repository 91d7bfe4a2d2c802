"""Chat formatting with a grammar that reads back what it writes.

A turn is written ``### role: text`` and, on a line of its own, ``</turn>``. A
deterministic parser cuts the formatted text at these control strings, unless a
backslash stands before them, and takes one backslash away from those it kept.
Every turn is first written as it is and parsed again; where the parser does not
give back the same role and text, the control strings of that text are escaped, and
what is written then is parsed again too: nothing is put out that does not read back.

Turns are ordered by turn, role and text. A null role or text is empty; rows that
are repeated are repeated turns; rows without ``conv_id`` form a conversation of
their own. Extra columns are ignored. An empty table gives no conversations. A conversation is one row of the
result, so its own size is what a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings: the opening sign and the closing line of a turn.
OPENING = "###"
CLOSING = "</turn>"
#: Unescaped control strings; a longer run of signs is one opening.
OPEN = r"(?<![\\#])###"
CLOSE = r"(?<!\\)</turn>"
#: Possessive, as a role ends at its first unescaped sign: Java matches other repeated groups by
#: recursion, which a role with thousands of escapes does not survive.
HEADER = r"(?s)^\n?### ([^\\:\n]*+(?:\\.[^\\:\n]*+)*+): (.*)\n\z"


def escape(text: Column) -> Column:
    """One more backslash before every control string and the backslashes before it."""
    return F.regexp_replace(text, r"(\\*)(###|</turn>)", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\*)(###|</turn>)", "$1$2")


def escape_role(role: Column) -> Column:
    """A backslash before whatever would end or break the header."""
    return F.regexp_replace(role, r"(?s)([\\:\n#<])", r"\\$1")


def unescape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"(?s)\\(.)", "$1")


def opening(role: Column) -> Column:
    return F.concat(F.lit(OPENING + " "), escape_role(role), F.lit(": "))


def written(role: Column, body: Column) -> Column:
    return F.concat(opening(role), body, F.lit(f"\n{CLOSING}\n"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as ``role, body``; null where a turn is not well formed."""
    parts = F.split(formatted, CLOSE, -1)

    def turn(part: Column) -> Column:
        body = F.regexp_extract(part, HEADER, 2)
        well_formed = part.rlike(HEADER) & ~body.rlike(OPEN)
        return F.when(
            well_formed,
            F.struct(unescape_role(F.regexp_extract(part, HEADER, 1)).alias("role"), body.alias("body")),
        )

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def reads_back(role: Column, text: Column, body: Column) -> Column:
    """Whether a turn written with ``body`` is parsed as one turn with this role and text."""
    turns = parse(written(role, body))
    first = F.get(turns, F.lit(0))
    same = (first["role"] == role) & (unescape(first["body"]) == text)
    return F.coalesce((F.size(turns) == 1) & same, F.lit(False))


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, segments``: each conversation's text, and its parts under the loss mask.

    The parts, one after another, are the formatted text; ``loss`` marks what an
    assistant says.
    """
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    role, text = F.col("role"), F.col("text")
    body = (
        F.when(reads_back(role, text, text), text)
        .when(reads_back(role, text, escape(text)), escape(text))
        .otherwise(F.raise_error(F.lit("a turn does not read back")).cast("string"))
    )
    bodies = turns.withColumn("body", body)
    rows = bodies.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "body"))).alias("turns")
    )
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                F.struct(opening(t["role"]).alias("text"), F.lit(False).alias("loss")),
                F.struct(t["body"].alias("text"), (t["role"] == "assistant").alias("loss")),
                F.struct(F.lit(f"\n{CLOSING}\n").alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    return rows.select("conv_id", segments.alias("segments")).select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
    )


def parse_chats(chats: DataFrame, *kept: str) -> DataFrame:
    """``conv_id, turns``: the roles and texts that a formatted text was written from."""
    turns = F.transform(
        parse(F.col("formatted")),
        lambda t: F.struct(t["role"].alias("role"), unescape(t["body"]).alias("text")),
    )
    return chats.select("conv_id", turns.alias("turns"), *kept)


def loss_text(segments: str = "segments") -> Column:
    """All text under the loss mask, as its source said it."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: unescape(s["text"])), "")


def digests(chats: DataFrame) -> DataFrame:
    """Figures of each conversation, read back from its formatted text and its mask."""
    line = F.lit("\n")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), "")
    read = parse_chats(chats, "segments", "formatted").withColumn("said", loss_text())
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("said").cast("long").alias("loss_chars"),
        F.sha2(F.col("said").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


#: A conversation of nothing but control strings, added to those of the table.
PLANTED_ID = -7
PLANTED_TEXT = "\\### Assistant: </turn> ok"


def with_planted(conversations: DataFrame) -> DataFrame:
    """The conversations and the planted one."""
    kinds = dict(conversations.dtypes)
    planted = conversations.sparkSession.range(2).select(
        F.lit(PLANTED_ID).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PLANTED_TEXT).alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionAll(planted)


#: The same figures from the source, without formatting and parsing.
CHECK_SQL = f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL
               SELECT {PLANTED_ID}, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '{PLANTED_TEXT}'
               FROM range(2) r(t)),
         w AS (SELECT *, CASE WHEN contains(text, '{OPENING}') OR contains(text, '{CLOSING}')
                              THEN regexp_replace(text, '(\\\\*)({OPENING}|{CLOSING})', '\\\\\\1\\2', 'g')
                              ELSE text END AS body,
                      regexp_replace(role, '([\\\\:\n#<])', '\\\\\\1', 'g') AS label
               FROM c)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum({len(OPENING) + 1} + length(label) + 2 + length(body) + {len(CLOSING) + 2}) AS BIGINT)
               AS formatted_chars
    FROM w GROUP BY conv_id"""
