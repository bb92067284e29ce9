"""Declared schemas of the pipeline's stages."""

CRAWL_META = (
    "url STRING, depth INT, referrer STRING, status STRING, http_code INT, fetched_at DOUBLE, elapsed_sec DOUBLE, outlink_count INT, content_hash STRING, content_path STRING, error STRING"
)
HTML_PAGES = "source_file STRING, html STRING"
RAW_PRODUCT = (
    "product_id BIGINT, source_file STRING, name STRING, brand STRING, category STRING, price_currency STRING, price STRING, ingredients STRING, description STRING, "
    "nutrition_table MAP<STRING,STRING>, unitpair STRING, highlights STRING"
)
PRODUCT = (
    "product_id BIGINT, source_file STRING, name STRING, brand STRING, category STRING, price_currency STRING, price STRING, ingredients ARRAY<STRING>, description STRING, "
    "nutrition_table MAP<STRING,STRING>, highlights STRING, unit_bundle STRUCT<price:STRING,unit:STRING>, price_num DOUBLE"
)
#: Reads the article dump whether or not its text element carries attributes.
WIKI_XML = "title STRING, ns INT, id BIGINT, revision STRUCT<text:STRUCT<_VALUE:STRING>>"
GOLDEN = (
    "name STRING, brand STRING, price_currency STRING, price STRING, ingredients ARRAY<STRING>, category STRING, description STRING, nutrition_table MAP<STRING,STRING>, "
    "unit_bundle STRUCT<price:STRING,unit:STRING>, highlights STRING, source_file STRING, product_id BIGINT"
)
_FACTS = "wiki_id: BIGINT, wiki_title: STRING, wiki_url: STRING, description: STRING"
ENRICHED = (
    PRODUCT + f", brand_wiki STRUCT<{_FACTS}, introduced: STRING, origin: STRING, website: STRING, infobox_type: STRING, categories: ARRAY<STRING>>, "
    f"ingredients_wiki ARRAY<STRUCT<name: STRING, {_FACTS}, type: STRING, categories: ARRAY<STRING>, is_sweetener: BOOLEAN, is_allergen: BOOLEAN, is_carcinogenic: BOOLEAN>>, "
    "wiki_enrichment STRUCT<has_brand_wiki: BOOLEAN, ingredients_wiki_count: INT, sweetener_count: BIGINT, allergen_count: BIGINT, carcinogen_count: BIGINT, total_wiki_matches: INT>"
)
