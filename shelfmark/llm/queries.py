"""Queries of the training-data operators: ``QUERIES`` and, where SQL can say it, ``SQL``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, table
from . import boilerplate, canonical, containers, copies, listings, markup, mixing, quality

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copy_pairs(table(spark, d, "unit_tests"))


def p1_copies(spark: SparkSession, d: str) -> DataFrame:
    return copies.collapsed(table(spark, d, "unit_tests"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return listings.listing_pairs(spread(table(spark, d, "unit_tests")), table(spark, d, "brand_reference"))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return listings.listing_groups(spread(table(spark, d, "unit_tests")), table(spark, d, "brand_reference"))


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    brand = canonical.map_values(table(spark, d, "unit_tests"), "brand", "product_id", table(spark, d, "brand_reference"), "brand_id", "brand")
    ingredient = canonical.map_values(
        table(spark, d, "build_ingredient_lookup"), "ingredient_normalized", "lookup_id", table(spark, d, "ingredient_reference"), "ingredient_id", "ingredient"
    )
    rows = [x.select(F.lit(f).alias("field"), F.col(i).alias("record_id"), "value", "ref_id") for x, f, i in ((brand, "brand", "product_id"), (ingredient, "ingredient", "lookup_id"))]
    return rows[0].unionByName(rows[1])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("field", "record_id", "ref_id").distinct()


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The report of values that no entry takes, with the number of their rows."""
    return _mapped(spark, d).where("ref_id = -1").groupBy("field", "value").agg(F.count("*").alias("n_rows"))


#: Fields of each table that may hold markup.
_MARKED = {"extract_wiki_articles": ("wiki_id", ["wiki_text"]), "postprocessing_extracted": ("product_id", ["description", "highlights"])}


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        markup.labelled(spread(table(spark, d, t)), i, fields).select(F.lit(t).alias("source_table"), F.col(i).alias("record_id"), "field", "kinds", "clean")
        for t, (i, fields) in _MARKED.items()
    ]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("source_table", "record_id", "field", F.explode("kinds").alias("kind")).distinct()


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    return _labelled(spark, d).select("source_table", "record_id", "field", "clean")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    body = boilerplate.main_body(table(spark, d, "html_to_products"))
    return body.select("source_file", F.md5(F.encode("line", "UTF-8")).alias("line_md5")).distinct()


def p6_body(spark: SparkSession, d: str) -> DataFrame:
    """The main body of each page as one text, lines in order."""
    lines = boilerplate.main_body(table(spark, d, "html_to_products")).groupBy("source_file").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    return lines.select("source_file", F.array_join("_l.line", "\n").alias("body"))


def _capacity(spark: SparkSession, d: str) -> int:
    return table(spark, d, "container_spec").select(F.min("capacity_tokens")).first()[0]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return containers.split_texts(containers.pack(spread(table(spark, d, "documents")), _capacity(spark, d)))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return containers.pack(spread(table(spark, d, "documents")), _capacity(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return containers.fill_report(p8_packed(spark, d), _capacity(spark, d))


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    return mixing.mix(spread(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).short_sources()


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report()


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).rows()


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_statistics(spread(table(spark, d, "documents")), table(spark, d, "common_words"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _statistics(spark, d).where("kind != 'prose'").select("doc_id", "kind").distinct()


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The basic counts, rounded; the kind of every document beside them."""
    s = _statistics(spark, d)
    return s.select("doc_id", "n_words", *(F.round(c, 4).alias(c) for c in ("mean_word_length", "symbol_ratio", "line_end_share", "common_share")))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_copies": p1_copies,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_unmatched": p3_unmatched,
    "p4_found": p4_found,
    "p4_clean": p4_clean,
    "p6_found": p6_found,
    "p6_body": p6_body,
    "p8_found": p8_found,
    "p8_packed": p8_packed,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_report": p9_report,
    "p9_mixture": p9_mixture,
    "p10_found": p10_found,
    "p10_statistics": p10_statistics,
}

_P1 = r"""
WITH f AS (
  SELECT product_id, regexp_replace(regexp_replace(lower(nfc_normalize(name)), '[\x{200B}-\x{200F}\x{2060}\x{FEFF}\x{00AD}''’‘`´ʼ]', '', 'g'), '(\d)\.(\d)', '\1·\2', 'g') AS n,
         regexp_replace(lower(nfc_normalize(source_file)), '[^\p{L}\p{N}]', '', 'g') AS s
  FROM unit_tests WHERE name IS NOT NULL AND source_file IS NOT NULL),
k AS (
  SELECT product_id, s, array_to_string(list_sort(list_filter(string_split(
           regexp_replace(regexp_replace(regexp_replace(n, '[^\p{L}\p{M}\p{N}·]+', ' ', 'g'), '([\d·])([^\d· ])', '\1 \2', 'g'), '([^\d· ])([\d·])', '\1 \2', 'g'), ' '), lambda x: x <> '')), ' ') AS n
  FROM f)
"""

_P10 = r"""
WITH c AS (SELECT lang, list(DISTINCT lower(word)) AS ws FROM common_words GROUP BY lang),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*') AS ws, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents),
h AS (SELECT doc_id, max(len(list_filter(w.ws, lambda x: list_contains(c.ws, lower(x))))) AS hits FROM w, c GROUP BY doc_id)
SELECT doc_id, cast(len(ws) AS bigint) AS n_words,
  round(CASE WHEN len(ws) > 0 THEN list_sum(list_transform(ws, lambda x: length(x)))::double / len(ws) ELSE 0 END, 4) AS mean_word_length,
  round(CASE WHEN length(regexp_replace(text, '\s', '', 'g')) > 0 THEN length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g'))::double / length(regexp_replace(text, '\s', '', 'g')) ELSE 0 END, 4) AS symbol_ratio,
  round(CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda x: regexp_matches(rtrim(x), '[.!?…]$')))::double / len(ls) ELSE 0 END, 4) AS line_end_share,
  round(CASE WHEN len(ws) > 0 THEN hits::double / len(ws) ELSE 0 END, 4) AS common_share
FROM w JOIN h USING (doc_id)
"""

SQL: dict[str, str] = {
    "p10_statistics": _P10,
    "p1_found": _P1 + "SELECT a.product_id AS product_id_a, b.product_id AS product_id_b FROM k a JOIN k b ON a.n = b.n AND a.s = b.s AND a.product_id < b.product_id",
    "p1_copies": _P1 + "SELECT min(product_id) AS class_id, count(*) AS copies FROM k GROUP BY n, s",
}
