"""Registered queries, each with the SQL its result is checked against."""

from folioscan.plans import audience, letters, pages, texts
from folioscan.plans.query import Query

ALL: dict[str, Query] = {**pages.QUERIES, **letters.QUERIES, **texts.QUERIES, **audience.QUERIES}
