"""Corpus analytics on Spark: chapters, lexicons, memories, pages and quality checks as DataFrame jobs."""

__version__ = "0.1.0"
