"""Pages to raw products, raw products to clean ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SiteRules
from ..functions import text as tx
from . import ingredients as ing


def rx(c: Column, pattern: str, group: int = 1) -> Column:
    """A regular-expression field, case and line breaks disregarded; null where it is missing or blank, else untrimmed."""
    return tx.blank_to_null(F.regexp_extract(c, "(?is)" + pattern, group))


def first_of(c: Column, patterns: tuple[str, ...]) -> Column:
    """The field that the first matching pattern gives."""
    return F.coalesce(*(rx(c, p) for p in patterns)) if patterns else F.lit(None).cast("string")


def raw_products(pages: DataFrame, rules: SiteRules | None = None) -> DataFrame:
    """One raw product per page, fields as found (blocks still hold markup, name and brand are decoded).

    The body is cropped once, in a projection of its own, with the whole page as a fallback; all
    patterns read that column. A page without a field has a null there; a null page has nulls.
    """
    rules = rules or SiteRules()
    body = pages.select(F.col("source_file"), F.coalesce(rx(F.col("html"), rules.body), F.col("html")).alias("body"))
    b = F.col("body")
    trail = F.regexp_extract_all(b, F.lit("(?is)" + rules.trail), 1)
    fields = body.select("source_file", "body", trail.alias("trail"))
    return fields.select(
        tx.stable_id("source_file").alias("product_id"),
        "source_file",
        tx.unescape_basic(rx(b, rules.name)).alias("name"),
        tx.unescape_basic(tx.blank_to_null(F.get("trail", F.lit(1)))).alias("brand"),
        tx.blank_to_null(F.get("trail", F.lit(0))).alias("category"),
        F.lit(rules.currency).alias("price_currency"),
        first_of(b, rules.prices).alias("price"),
        rx(b, rules.ingredients).alias("ingredients"),
        rx(b, rules.description).alias("description"),
        F.create_map(*(x for n, p in rules.nutrients.items() for x in (F.lit(n), F.trim(tx.unescape_basic(rx(b, p)))))).alias("nutrition_table"),
        first_of(b, rules.unit_pairs).alias("unitpair"),
        rx(b, rules.highlights).alias("highlights"),
    )


def complete(products: DataFrame) -> DataFrame:
    """Products that have a name and a price."""
    return products.dropna(subset=["name", "price"])


def block_lines(c: Column, item: str) -> Column:
    """Lines of a block: the texts of its ``item`` elements, cleaned, blanks dropped, joined by blanks."""
    found = F.regexp_extract_all(c, F.lit(f"(?is)<{item}[^>]*>(.*?)</{item}>"), 1)
    return F.array_join(F.filter(F.transform(found, lambda x: tx.strip_html(x)), lambda x: x != ""), " ")


def clean_products(raw: DataFrame, mode: str = "block") -> DataFrame:
    """Plain text for every block, ingredients as an array, unit price as a struct, price as a number where it is one.

    ``mode`` 'block' strips a whole block; 'lines' joins its span (or list) items.
    """
    text = {"description": tx.strip_html("description"), "highlights": tx.strip_html("highlights")}
    if mode == "lines":
        text = {"description": block_lines(F.col("description"), "span"), "highlights": block_lines(F.col("highlights"), "li")}
    out = raw.withColumns({"category": tx.strip_html("category"), **text, "ingredients": ing.split(tx.strip_html("ingredients")), "unit_bundle": tx.unit_pair("unitpair"), "price_num": F.expr("try_cast(price AS double)")})
    return out.drop("unitpair")


def first_by_name(df: DataFrame, name: str = "name", order: str = "source_file", tie: str = "product_id") -> DataFrame:
    """The first row of every normalised name; rows without a name are kept out. Ties fall to the smaller ``tie``."""
    keyed = df.withColumn("_key", tx.dedupe_key(name)).where("_key is not null")
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(order, tie))
    return keyed.withColumn("_n", rank).where("_n = 1").drop("_key", "_n")


def with_serial(df: DataFrame, order: list[str], to: str = "serial") -> DataFrame:
    """Serial numbers from 1 in a total order, without gathering rows in one task.

    Rows are range-partitioned and counted per partition; each partition then starts where
    the ones before it end, so only one row per partition is ever summed centrally.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    sizes = parts.groupBy("_p").count()
    starts = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return parts.join(F.broadcast(starts), F.col("_p") == F.col("_q")).withColumn(to, F.col("_start") + inside).drop("_p", "_q", "_start")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
