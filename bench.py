"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Ranked searches are timed on an index
that is built, written and read back first (its time is reported as ``index_build`` and
``fielded_build``), each once after a warm-up query, from files (nothing is cached); other queries
run from their tables, once, results counted in full.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from shelfmark import queries as core
from shelfmark.operators import catalog, index
from shelfmark.plans import compile as search

#: Six shopping queries, as published latencies are given for six.
SEARCHES = ("chocolate sweeteners", "semi skimmed milk", "pumpkin lights", "mini muffins multipack", "bear gift", "smart wipes")
HEADLINES = ("p5_found", "p7_found", "raw_products", "unique_ingredients", "article_matches", "brand_lookup", "category_lookup", "enriched_products", "page_links", "storage_statistics", "tfidf_docs")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    work = tempfile.mkdtemp(prefix="shelfmark-bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{work}/checkpoints").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 3)

    try:
        spark.range(1000).selectExpr("sum(id)").collect()
        timed("index_build", lambda: index.write(core.table(spark, sf, "documents"), "doc_id", F.col("text"), f"{work}/index"))
        timed("fielded_build", lambda: catalog.write(core._enriched(spark, sf), f"{work}/fielded"))
        flat, fielded = index.read(spark, f"{work}/index"), search.read(spark, f"{work}/fielded")
        index.search(flat, "warm up", "idf_l2").collect()
        search.search_products(fielded, "warm up", catalog.SEARCH_FIELDS).collect()
        for n, text in enumerate(SEARCHES, 1):
            timed(f"search_tfidf_{n}", lambda: index.search(flat, text, "idf_l2").collect())  # noqa: B023
            timed(f"search_bm25_{n}", lambda: search.search_products(fielded, text, catalog.SEARCH_FIELDS, fuzzy=False).collect())  # noqa: B023
            timed(f"search_fuzzy_{n}", lambda: search.search_products(fielded, text, catalog.SEARCH_FIELDS).collect())  # noqa: B023
        mean = lambda kind: round(sum(took[f"{kind}_{n}"] for n in range(1, 7)) / 6, 3)
        took |= {f"{k}_mean": mean(k) for k in ("search_tfidf", "search_bm25", "search_fuzzy")}
        for name in HEADLINES:
            timed(name, lambda: core.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())  # noqa: B023
        try:
            from shelfmark.llm import queries as llm
        except ImportError:
            llm = None
        for name in sorted(n for n in (llm.QUERIES if llm else {}) if n.endswith("_found")):
            timed(name, lambda: llm.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())  # noqa: B023
        total = sum(v for k, v in took.items() if not k.endswith("_mean"))
        print(json.dumps({"metric": "headline_total", "value": round(total, 3), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))
    finally:
        spark.stop()
        shutil.rmtree(work, ignore_errors=True)


if __name__ == "__main__":
    main()
