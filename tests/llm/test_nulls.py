"""Every column null, ids included; ids beyond the range of exact floats."""

import os

import pytest

from shelfmark.llm import boilerplate, canonical, containers, copies, listings, markup, mixing, quality, tokens
from shelfmark.operators import packed, units

BIG = 2**62 + 1
needs_vocabulary = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def rows(spark):
    schema = "product_id long, name string, brand string, category string, description string, highlights string, source_file string, html string, text string, source string"
    full = (BIG, "Acme Lime Squash 1L", "Acme", "Drinks", "<p>x</p>", "y", "s", "<h1>T</h1><p>£1</p>", "some text here", "a")
    return spark.createDataFrame([full, (None,) * 10, (None,) * 10, (7, *(None,) * 9)], schema).coalesce(1)


def test_copies_and_listings(spark, rows):
    assert {r["product_id"] for r in copies.copy_classes(rows).collect()} == {BIG, None, 7}
    assert copies.copy_pairs(rows).count() == 0
    brands = spark.createDataFrame([(1, "Acme"), (2, None), (None, "Other")], "brand_id long, brand string").where("brand_id is not null")
    assert {r["product_id"]: r["links"] for r in listings.listing_groups(rows, brands).where("product_id is not null").collect()} == {BIG: 0, 7: 0}
    assert listings.listing_pairs(rows, brands).count() == 0


def test_values_markup_pages_statistics(spark, rows):
    ref = spark.createDataFrame([(BIG, "ACME!")], "k long, e string")
    assert [tuple(r) for r in canonical.map_values(rows, "brand", "product_id", ref, "k", "e").collect()] == [(BIG, "Acme", BIG)]
    assert [r["product_id"] for r in markup.labelled(rows, "product_id", ["description"]).collect()] == [BIG]
    assert [r["line"] for r in boilerplate.main_body(rows).collect()] == ["T", "£1"]
    common = spark.createDataFrame([("en", "the"), (None, "x"), ("en", None)], "lang string, word string")
    got = quality.document_statistics(rows, common, "product_id").collect()
    assert sorted((r["product_id"] or 0, r["n_words"]) for r in got) == [(0, 0), (0, 0), (7, 0), (BIG, 3)]


def test_core(spark, rows):
    df = rows.selectExpr("product_id", "name", "description", "highlights", "cast(null as string) as energy", "'1.00' as price", "'kg' as unit")
    assert units.common_quantities(df, "product_id", "energy", "price", "unit").count() == 4
    assert packed.split_values(rows, "text", "product_id").count() == 1


@needs_vocabulary
def test_containers_and_mixing(spark, rows):
    packed_rows = containers.pack(rows, 8, "product_id").collect()
    assert sorted((r["product_id"] or 0, r["container_id"] is None) for r in packed_rows) == [(0, True), (0, True), (7, True), (BIG, False)]
    targets = spark.createDataFrame([("a", 1.0, 1), (None, 0.5, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mix(rows, targets, "product_id", block_tokens=1)
    assert {r["id"] for r in m.rows().collect()} == {BIG}
