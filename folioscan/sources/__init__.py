"""Reading and writing document corpora."""

from folioscan.sources.files import in_part, read_docs, read_pages, read_texts, read_written, write_docs

__all__ = ["in_part", "read_docs", "read_pages", "read_texts", "read_written", "write_docs"]
