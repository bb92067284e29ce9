"""Command line: the stages of the pipeline over files and folders."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import SiteRules
from .operators import articles, catalog, enrich, entities, extract, index, lookups, stats
from .plans import compile as search
from .session import ship
from .sources import readers, sinks


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shelfmark")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, **paths: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for k, text in paths.items():
            c.add_argument(f"--{k}", required=True, help=text)
        return c

    c = command("extract", pages="glob of page files", out="folder of products")
    c.add_argument("--rules", help="JSON file of site rules")
    command("entities", products="folder of products", out="folder of entity tables")
    command("articles", dump="article dump (XML)", entities="folder of entity tables", out="folder of articles")
    command("lookups", entities="folder of entity tables", articles="folder of articles", out="folder of lookups")
    command("enrich", products="folder of products", lookups="folder of lookups", out="folder of enriched products")
    command("build-index", products="folder of products", out="folder of the TF-IDF index")
    c = command("query", index="folder of the TF-IDF index", products="folder of products")
    c.add_argument("--mode", choices=("idf", "idf_l2"), default="idf_l2")
    c.add_argument("--topk", type=int, default=10)
    c.add_argument("terms", nargs="+")
    command("build-fielded-index", products="folder of enriched products", out="folder of the fielded index")
    c = command("search", index="folder of the fielded index")
    c.add_argument("--field")
    c.add_argument("--topk", type=int, default=10)
    c.add_argument("--no-fuzzy", action="store_true")
    c.add_argument("terms", nargs="+")
    command("stats", pages="table of url and html (Parquet)")
    command("test", golden="golden records", pages="glob of page files")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("shelfmark").getOrCreate()
    ship(spark)
    began = time.time()
    if a.command == "extract":
        raw = extract.complete(extract.raw_products(readers.html_pages(spark, a.pages), SiteRules.load(a.rules) if a.rules else None))
        sinks.write_records(extract.first_by_name(extract.clean_products(raw)), a.out)
    elif a.command == "entities":
        p = readers.products(spark, a.products)
        for name, df in (("brands", entities.brands(p)), ("categories", entities.categories(p)), ("ingredients", entities.ingredients(p))):
            sinks.write_table(df, f"{a.out}/{name}")
    elif a.command == "articles":
        b, c, i = (spark.read.parquet(f"{a.entities}/{n}") for n in ("brands", "categories", "ingredients"))
        kept = articles.matching(articles.content_pages(readers.article_dump(spark, a.dump)), entities.terms(b, c, i))
        sinks.write_table(articles.featured(kept), a.out)
    elif a.command == "lookups":
        b, c, i = (spark.read.parquet(f"{a.entities}/{n}") for n in ("brands", "categories", "ingredients"))
        found = spark.read.parquet(a.articles)
        for name, df in (("brands", lookups.brand_lookup(b, found)), ("ingredients", lookups.ingredient_lookup(i, found)), ("categories", lookups.category_lookup(c, found))):
            sinks.write_table(df, f"{a.out}/{name}")
    elif a.command == "enrich":
        out = enrich.enrich(readers.products(spark, a.products), spark.read.parquet(f"{a.lookups}/brands"), spark.read.parquet(f"{a.lookups}/ingredients"))
        sinks.write_records(out, a.out)
    elif a.command == "build-index":
        from .functions.text import doc_text

        index.write(readers.products(spark, a.products), "product_id", doc_text("name", "brand", "category", "description", F.array_join("ingredients", " ")), a.out)
    elif a.command == "query":
        hits = index.search(index.read(spark, a.index), " ".join(a.terms), a.mode, a.topk)
        index.with_metadata(hits, readers.products(spark, a.products).select("product_id", "name", "brand", "price"), "product_id").orderBy("rank").show(a.topk, False)
    elif a.command == "build-fielded-index":
        catalog.write(readers.enriched_products(spark, a.products), a.out)
    elif a.command == "search":
        search.search_products(search.read(spark, a.index), " ".join(a.terms), catalog.SEARCH_FIELDS, a.topk, a.field, not a.no_fuzzy).show(a.topk, False)
    elif a.command == "stats":
        stats.storage(spark.read.parquet(a.pages)).show(truncate=False)
    elif a.command == "test":
        golden = readers.golden_records(spark, a.golden)
        got = extract.clean_products(extract.raw_products(readers.html_pages(spark, a.pages)))
        stats.accuracy(golden, got, "source_file", ["name", "brand", "category", "price", "ingredients", "description", "nutrition_table", "unit_bundle", "highlights"]).show(truncate=False)
    print(f"{time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
