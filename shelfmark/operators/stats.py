"""Storage statistics, token counts and extraction accuracy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BLOCKED
from ..functions import text as tx
from ..functions import urls

#: Characters of a page that are looked at for signs of blocking.
LOOK = 200_000


def is_blocked(html: Column, signs: tuple[str, ...] = BLOCKED) -> Column:
    """Whether a page is a denial: any sign in its first 200,000 characters, case disregarded; null is not."""
    head = F.lower(F.substring(html, 1, LOOK))
    found = F.lit(False)
    for s in signs:
        found = found | F.contains(head, F.lit(s.lower()))
    return F.coalesce(found, F.lit(False))


def storage(files: DataFrame, url: str = "url", html: str = "html", size: Column | None = None) -> DataFrame:
    """One row: counts, bytes, MiB and percentages of all, product, other, blocked and good pages. Shares of nothing are 0."""
    size = F.octet_length(html) if size is None else size
    d = files.select(urls.is_product_page(F.col(url)).alias("product"), is_blocked(F.col(html)).alias("blocked"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("bytes"))
    product, blocked = F.coalesce("product", F.lit(False)), F.col("blocked")
    total = F.count("*")
    share = lambda n: F.round(F.coalesce(F.try_divide(n * 100.0, total), F.lit(0.0)), 4)
    return d.agg(
        total.alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / 1048576.0, 4).alias("mib"), F.count_if(product).alias("product_pages"),
        F.greatest(total - F.count_if(product), F.lit(0)).alias("other_pages"), F.count_if(blocked).alias("blocked_pages"), F.greatest(total - F.count_if(blocked), F.lit(0)).alias("good_pages"),
        share(F.count_if(product)).alias("product_share"), share(F.count_if(blocked)).alias("blocked_share"), F.coalesce(F.sum(F.when(product, F.col("bytes"))), F.lit(0)).alias("product_bytes"),
    )


def flattened(c: Column, kind: T.DataType) -> Column:
    """All values of a nested column as one text, depth first, nulls skipped."""
    if isinstance(kind, T.StructType):
        return F.concat_ws(" ", *(flattened(c[f.name], f.dataType) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(c, lambda x: flattened(x, kind.elementType)), " ")
    if isinstance(kind, T.MapType):
        return F.array_join(F.transform(F.map_values(c), lambda x: flattened(x, kind.valueType)), " ")
    return c.cast("string")


def token_count(df: DataFrame, counter: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row: records and the tokens of all their values. The default counts words and signs by a regular expression; a tokenizer's counter may be given."""
    count = counter or (lambda c: F.size(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+|[^\s\p{L}\p{N}])"), 1)))
    text = F.concat_ws(" ", *(flattened(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields))
    return df.select(count(text).alias("n")).agg(F.count("*").alias("records"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))


def same_list(a: Column, b: Column) -> Column:
    """Ordered lists equal after normalisation; null equals null."""
    return F.transform(a, tx.comparable).eqNullSafe(F.transform(b, tx.comparable))


def same_map(a: Column, b: Column) -> Column:
    """Maps equal over the union of their keys, a missing key counting as null."""
    empty = F.create_map().cast("map<string,string>")
    x, y = F.coalesce(a, empty), F.coalesce(b, empty)
    return F.forall(F.array_union(F.map_keys(x), F.map_keys(y)), lambda k: tx.comparable(F.try_element_at(x, k)).eqNullSafe(tx.comparable(F.try_element_at(y, k))))


def same_struct(a: Column, b: Column, fields: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for f in fields:
        out = out & tx.comparable(a[f]).eqNullSafe(tx.comparable(b[f]))
    return out


def accuracy(expected: DataFrame, extracted: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(field, passed, total)``, sorted by field. Every expected record counts for every field, found or not; a missing expected value must be missing.

    Arrays compare in order, maps over the union of keys, structs by field, scalars normalised.
    """
    e, x = expected.select(key, *(F.col(f).alias(f"e_{f}") for f in fields)), extracted.select(key, *(F.col(f).alias(f"x_{f}") for f in fields)).withColumn("_found", F.lit(True))
    joined = e.join(x, key, "left")

    def pair(f: str) -> Column:
        """Scalars go on as texts, to be normalised once for all fields; nested values are compared here."""
        a, b, kind = F.col(f"e_{f}"), F.col(f"x_{f}"), expected.schema[f].dataType
        nested = F.lit(None).cast("boolean")
        if isinstance(kind, T.ArrayType):
            nested = same_list(a, b)
        elif isinstance(kind, T.MapType):
            nested = same_map(a, b)
        elif isinstance(kind, T.StructType):
            nested = same_struct(a, b, tuple(kind.fieldNames()))
        scalar = not isinstance(kind, (T.ArrayType, T.MapType, T.StructType))
        text = lambda c: (c.cast("string") if scalar else F.lit(None).cast("string"))
        return F.struct(F.lit(f).alias("field"), text(a).alias("e"), text(b).alias("x"), nested.alias("nested"))

    rows = joined.select(F.coalesce("_found", F.lit(False)).alias("found"), F.explode(F.array(*map(pair, fields))).alias("r")).select("found", "r.*")
    ok = F.col("found") & F.coalesce("nested", tx.comparable("e").eqNullSafe(tx.comparable("x")))
    return rows.groupBy("field").agg(F.count_if(ok).alias("passed"), F.count("*").alias("total")).orderBy("field")
