"""Regular expressions and labels.

Fixed values, stated as text. Every pattern stays inside the common ground of
Java regex and RE2 (no look-around, no back-references), so the same pattern
gives the same answer in Spark and in the SQL the results are checked against.
Nothing repeats a group with alternatives, which Java matches by recursion.
"""

from __future__ import annotations

# An attribute value: double-quoted, single-quoted or bare.
VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""

TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
LANG = r"(?i)<html\b[^>]*?\slang\s*=\s*" + VALUE
HIDDEN = r"""(?is)^<[^>]*?\sstyle\s*=\s*(?:"[^">]*display\s*:\s*none[^">]*"|'[^'>]*display\s*:\s*none[^'>]*')"""
ANCHOR_START = r"(?i)<a\s"
ANCHOR_HREF = r"(?i)<a(?:\s[^>]*?)?\shref\s*=\s*" + VALUE
SEGMENT_HREF = r"(?i)^[^>]*?\shref\s*=\s*" + VALUE
SEGMENT_TEXT = r"(?is)^[^>]*>(.*?)(?:</a\s*>|$)"
IMG = r"(?i)<img\b[^>]*>"
COMMENT_LINE = r"<!--[ \t]*([^\n]*?)[ \t]*-->"
FIRST_COMMENT = r"(?s)<!--(.*?)-->"
COMMENT_SUBJECT = r"ASUNTO:[ \t]*([^\n\r]*)"
COMMENT_PREHEADER = r"PREHEADER:[ \t]*([^\n\r]*)"
TAG_NAME = r"<([A-Za-z][A-Za-z0-9]*)"
# Group 1 stays empty for a character reference such as "&#128512;".
COLOUR = r"&#|(#[0-9a-fA-F]{6})\b"
FONT_STACK = r"""(?i)font-family\s*:\s*([^;{}]+)"""
STYLE_ATTRIBUTE = r"(?i)<[a-z][^>]*?\sstyle\s*=\s*" + VALUE
STYLE_BLOCK = r"(?is)<style\b[^>]*>(.*?)</style\s*>"
CSS_NOISE = r"(?s)/\*.*?\*/|@import[^;]*;|\{[^{}]*\}"
CSS_CLASS = r"\.(-?[A-Za-z_][A-Za-z0-9_-]*)"
CLASS_ATTRIBUTE = r"(?i)<[a-z][^>]*?\sclass\s*=\s*" + VALUE
MERGE_TAG = r"\{\{\s*([A-Za-z_][A-Za-z0-9_.]*)\s*\}\}"
UNSUBSCRIBE_TAG = r"\{\{\s*unsubscribe_url\s*\}\}"

# Comments go whole; of scripts and styles the tags stay (groups 1 to 4).
NOT_MARKUP = (
    r"(?is)<!--.*?-->|(<script\b[^>]*>).*?(</script\s*>)|(<style\b[^>]*>).*?(</style\s*>)"
)
NOT_LIVE = r"(?is)<!--.*?-->|(<script\b[^>]*>).*?(</script\s*>)"
QUOTED = r"""(?s)"[^"]*"|'[^']*'"""

# Visible text: what is not shown goes first, then every remaining tag. All
# branches share their first character, so other text is passed over quickly. A
# "<" before anything but a letter or one of "/!?" is text, as in HTML.
NOT_SHOWN = (
    r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>"
    r"|title\b.*?</title\s*>|[a-z/!?][^>]*>)"
)
TAG = r"<[A-Za-z/!?][^>]*>"
SPACES = r"\s+"

# Links.
SCHEME = r"^\s*([A-Za-z][A-Za-z0-9+.\-]*):"
HOST = r"^\s*(?:https?:)?//(?:[^/?#@]*@)?([^/?#:\s]+)"
MAIL_SUBJECT = r"(?i)[?&;]subject=([^&#]*)"

# Amounts are written with a decimal comma and a dot between thousands.
AMOUNT = r"\b(\d[\d.]*(?:,\d+)?)"
EURO = r"\s*(?:&nbsp;\s*)?(?:€|&euro;)"
PRICE = AMOUNT + EURO
PACK_PRICE = r"\b(\d+) páginas (?:por|=) " + AMOUNT + EURO + r"(?: \(" + AMOUNT + EURO + r"/)?"

# Labels of a before/after pair of links.
BEFORE_LABEL = "Antes"
AFTER_LABEL = "Después"


def attribute(name: str) -> str:
    """Pattern for the value of one attribute inside a single tag."""
    return rf"(?i)\s{name}\s*=\s*" + VALUE


def has_attribute(name: str) -> str:
    """Pattern for an attribute, with a value or without, of a tag whose quoted values are empty."""
    return rf"(?i)\s{name}(?:[\s=/>]|$)"


def tag_edges(tag: str) -> str:
    """Pattern for the opening (group 1 empty) and closing ('/') marks of a tag."""
    return rf"(?i)<(/?){tag}(?:[\s/][^>]*)?>"
