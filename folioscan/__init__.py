"""Spark operators for corpora of HTML mailings and pages."""
