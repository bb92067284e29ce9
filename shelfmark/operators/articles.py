"""Articles of a dump: which to keep, and what is stored of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import wiki


def content_pages(dump: DataFrame) -> DataFrame:
    """Articles of the main namespace that have text and are no redirect."""
    return dump.where("ns = 0 and text is not null").where(~F.col("text").rlike(wiki.REDIRECT))


def matching(articles: DataFrame, terms: DataFrame, title: str = "title", key: str = "id") -> DataFrame:
    """Articles whose title is a term: a left semi join on the normalised title, one row per article id."""
    keyed = articles.withColumn("_term", tx.normalize_alnum(title)).where("_term != ''")
    return keyed.join(terms.select(F.col("term").alias("_term")), "_term", "left_semi").drop("_term").dropDuplicates([key])


def featured(articles: DataFrame, key: str = "id", title: str = "title", text: str = "text") -> DataFrame:
    """Rows with id, title, features and text."""
    f = wiki.features(F.col(title), F.col(text))
    return articles.select(F.col(key).alias("wiki_id"), F.col(title).alias("wiki_title"), *(c.alias(n) for n, c in f.items()), F.col(text).alias("wiki_text"))
