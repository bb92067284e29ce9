"""Distinct brands, categories and ingredients, and the terms they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Ingredients too general to look up.
GENERIC = ("water", "salt")


def _present(c: str) -> Column:
    return F.length(F.trim(c)) > 0


def brands(products: DataFrame) -> DataFrame:
    return products.where(_present("brand")).select("brand").distinct().withColumn("brand_normalized", tx.normalize_ws("brand"))


def categories(products: DataFrame) -> DataFrame:
    out = products.where(_present("category")).select("category").distinct().withColumn("category_normalized", tx.normalize_ws("category"))
    return out.withColumn("category_main", tx.main_keyword("category_normalized"))


def ingredients(products: DataFrame) -> DataFrame:
    out = products.select(F.explode("ingredients").alias("ingredient")).where(_present("ingredient")).distinct().withColumn("ingredient_normalized", tx.normalize_ws("ingredient"))
    return out.withColumn("is_generic", F.col("ingredient_normalized").isin(*GENERIC) | (F.length("ingredient_normalized") < 3))


def terms(brand: DataFrame, category: DataFrame, ingredient: DataFrame) -> DataFrame:
    """Distinct alphanumeric terms of all entities; generic ingredients are left out, and so is what normalises to nothing."""
    columns = [brand.select(F.col("brand_normalized").alias("t")), category.select(F.col("category_normalized").alias("t")), category.select(F.col("category_main").alias("t")), ingredient.where("not is_generic").select(F.col("ingredient_normalized").alias("t"))]
    out = columns[0]
    for c in columns[1:]:
        out = out.unionByName(c)
    return out.select(tx.normalize_alnum("t").alias("term")).where("term != ''").distinct()
