"""Shelfmark: a Spark-first engine for catalogue extraction, linking, search and data cleaning."""

__version__ = "0.1.0"
