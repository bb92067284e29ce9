"""The fielded index of enriched products: which columns are searched as text, as keywords, and stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import compile as search

#: Fields of the default search.
SEARCH_FIELDS = ("name", "description", "ingredients", "highlights", "brand", "category", "brand_description", "ingredient_wiki_names", "ingredient_descriptions", "brand_introduced", "brand_origin")
KEYWORDS = ("brand", "category", "price_currency", "brand_wiki_title", "brand_wiki_url", "brand_introduced", "brand_origin", "brand_website", "brand_infobox_type")


def _joined(field: str) -> Column:
    """A member of the ingredient facts, non-empty ones joined by a blank."""
    return F.array_join(F.filter(F.transform("ingredients_wiki", lambda x: x[field]), lambda t: F.length(t) > 0), " ")


def columns() -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """Text, keyword and stored columns over enriched products. A price of 0 is absent."""
    text = {
        "name": F.col("name"), "description": F.col("description"), "highlights": F.col("highlights"), "ingredients": F.array_join("ingredients", " "),
        "brand_description": F.col("brand_wiki.description"), "brand_categories": F.array_join("brand_wiki.categories", " "),
        "ingredient_descriptions": _joined("description"), "ingredient_wiki_names": _joined("name"), "ingredient_types": _joined("type"),
    }
    keywords = {c: F.col(c) for c in ("brand", "category", "price_currency")} | {f"brand_{c}": F.col(f"brand_wiki.{c}") for c in ("wiki_title", "wiki_url", "introduced", "origin", "website", "infobox_type")}
    stored = text | keywords | {
        "price_num": F.expr("nullif(try_cast(price AS double), 0)"), "n_ingredients": F.coalesce(F.size("ingredients"), F.lit(0)), "ingredients_wiki_json": F.when(F.size("ingredients_wiki") > 0, F.to_json("ingredients_wiki")),
        "has_brand_wiki": F.col("wiki_enrichment.has_brand_wiki").cast("int"),
        **{c: F.col(f"wiki_enrichment.{c}").cast("int") for c in ("ingredients_wiki_count", "allergen_count", "sweetener_count", "carcinogen_count", "total_wiki_matches")},
    }
    return text, keywords, stored


def build(enriched: DataFrame) -> search.FieldedIndex:
    text, keywords, stored = columns()
    return search.build(enriched, "product_id", text, stored, keywords)


def write(enriched: DataFrame, path: str) -> None:
    text, keywords, stored = columns()
    search.write(enriched, "product_id", text, stored, path, keywords)
