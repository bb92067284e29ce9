"""Products joined to the facts found on their brands and ingredients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BRAND = ("wiki_id", "wiki_title", "wiki_url", "wiki_description", "introduced", "origin", "website", "infobox_type", "categories")


def enrich(products: DataFrame, brand_facts: DataFrame, ingredient_facts: DataFrame) -> DataFrame:
    """Every product once, with ``brand_wiki``, ``ingredients_wiki``, three counts and ``wiki_enrichment``.

    Keys are the raw values; a null brand matches nothing. The ingredient side is aggregated by
    product before it meets the products, and its array is sorted, so results do not depend on
    task order. Both lookups hold one row per key (see ``lookups``).
    """
    b = brand_facts.select(F.col("brand").alias("_brand"), F.struct(*(F.col(c).alias("description" if c == "wiki_description" else c) for c in _BRAND)).alias("brand_wiki"))
    i = ingredient_facts.select(
        F.col("ingredient").alias("_ingredient"), "is_sweetener", "is_allergen", "is_carcinogenic",
        F.struct(
            F.col("ingredient").alias("name"), "wiki_id", "wiki_title", "wiki_url", F.col("wiki_description").alias("description"), F.col("infobox_type").alias("type"), "categories",
            "is_sweetener", "is_allergen", "is_carcinogenic",
        ).alias("fact"),
    )
    used = products.select("product_id", F.explode("ingredients").alias("_ingredient")).join(i, "_ingredient")
    per = used.groupBy("product_id").agg(
        F.array_sort(F.collect_list("fact")).alias("ingredients_wiki"), F.count_if("is_sweetener").alias("sweetener_count"), F.count_if("is_allergen").alias("allergen_count"), F.count_if("is_carcinogenic").alias("carcinogen_count")
    )
    out = products.join(b, F.col("brand") == F.col("_brand"), "left").drop("_brand").join(per, "product_id", "left")
    counts = ("sweetener_count", "allergen_count", "carcinogen_count")
    empty = F.from_json(F.lit("[]"), per.schema["ingredients_wiki"].dataType)
    out = out.withColumns({"ingredients_wiki": F.coalesce("ingredients_wiki", empty), **{c: F.coalesce(c, F.lit(0)) for c in counts}})
    has_brand = F.col("brand_wiki.wiki_id").isNotNull()
    n = F.size("ingredients_wiki")
    return out.withColumn("wiki_enrichment", F.struct(has_brand.alias("has_brand_wiki"), n.alias("ingredients_wiki_count"), *counts, (has_brand.cast("int") + n).alias("total_wiki_matches")))


def summary(enriched: DataFrame) -> DataFrame:
    """One row of counters and averages, in one pass."""
    return enriched.agg(
        F.count("*").alias("products"), F.count_if("wiki_enrichment.has_brand_wiki").alias("with_brand"), F.count_if(F.size("ingredients_wiki") > 0).alias("with_ingredients"),
        F.round(F.avg(F.size("ingredients_wiki")), 6).alias("avg_ingredients"), F.round(F.avg("sweetener_count"), 6).alias("avg_sweeteners"), F.round(F.avg("allergen_count"), 6).alias("avg_allergens"), F.round(F.avg("carcinogen_count"), 6).alias("avg_carcinogens"),
    )


def most_allergens(enriched: DataFrame, k: int = 5) -> DataFrame:
    return enriched.select("product_id", "name", "allergen_count").orderBy(F.desc("allergen_count"), "product_id").limit(k)
