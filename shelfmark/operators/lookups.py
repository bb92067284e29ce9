"""Entities joined to the articles that describe them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wiki

_STORED = ("wiki_id", "wiki_title", "wiki_url", "has_infobox", "infobox_type", "categories")


def _matched(entities: DataFrame, articles: DataFrame, key: str, raw: str, extra: dict[str, Column], fanout: bool) -> DataFrame:
    """Inner join on the normalised value; facts are read only from joined articles. Without ``fanout``, one row per raw value (the smallest article id)."""
    a = articles.select(*_STORED, F.col("title_normalized").alias("_title"), F.col("wiki_text").alias("_text"))
    joined = entities.join(a, F.col(key) == F.col("_title")).where(f"{key} != ''")
    if not fanout:
        n = F.row_number().over(Window.partitionBy(raw).orderBy("wiki_id"))
        joined = joined.withColumn("_n", n).where("_n = 1").drop("_n")
    return joined.withColumns({**wiki.facts(F.col("_text")), **extra}).drop("_title", "_text")


def brand_lookup(brands: DataFrame, articles: DataFrame, fanout: bool = False) -> DataFrame:
    out = _matched(brands, articles, "brand_normalized", "brand", {}, fanout)
    return out.select("brand", "brand_normalized", "wiki_id", "wiki_title", "wiki_url", "wiki_description", "introduced", "origin", "website", "has_infobox", "infobox_type", "categories")


def ingredient_lookup(ingredients: DataFrame, articles: DataFrame, fanout: bool = False) -> DataFrame:
    """As for brands, with flags of sweeteners, allergens and carcinogens; generic ingredients are looked up too."""
    out = _matched(ingredients, articles, "ingredient_normalized", "ingredient", wiki.health_flags(F.col("_text")), fanout)
    columns = ("wiki_id", "wiki_title", "wiki_url", "wiki_description", "introduced", "origin", "website", "is_sweetener", "is_allergen", "is_carcinogenic", "has_infobox", "infobox_type", "categories")
    return out.select("ingredient", "ingredient_normalized", *columns)


#: Confidence of a match on the main keyword and on the whole category.
CONFIDENCE_MAIN, CONFIDENCE_FULL = 0.80, 0.75


def category_lookup(categories: DataFrame, articles: DataFrame) -> DataFrame:
    """Best match of every category over two tiers: its main keyword, then its whole name.

    Unmatched categories stay, with confidence 0. Ties fall to the method's name, then to the
    smaller article id.
    """
    a = articles.select("wiki_id", "wiki_title", "categories", F.col("title_normalized").alias("_title"), wiki.first_paragraph(F.col("wiki_text")).alias("wiki_description"))

    def tier(key: Column, method: str, confidence: float) -> DataFrame:
        joined = categories.join(a, key == F.col("_title"), "left")
        return joined.select("category", "category_normalized", "category_main", "wiki_id", "wiki_title", "wiki_description", "categories", F.lit(method).alias("match_method"), F.when(F.col("wiki_id").isNotNull(), confidence).otherwise(0.0).alias("confidence"))

    both = tier(F.nullif(F.lower("category_main"), F.lit("")), "main_keyword", CONFIDENCE_MAIN).unionByName(tier(F.nullif("category_normalized", F.lit("")), "full_name", CONFIDENCE_FULL))
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("confidence"), "match_method", F.asc_nulls_last("wiki_id")))
    return both.withColumn("_n", rank).where("_n = 1").drop("_n")
