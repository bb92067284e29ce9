"""Scans: pages, record files, article dumps, logs and configuration."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def html_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row ``(source_file, html)`` per file; bytes that are no UTF-8 become replacement characters."""
    pages = spark.read.text(path, wholetext=True)
    return pages.select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("html"))


def records(spark: SparkSession, path: str, schema: str, malformed: str = "null") -> DataFrame:
    """Newline-delimited JSON with a declared schema. Blank lines give no row; malformed lines give nulls or are dropped."""
    mode = {"null": "PERMISSIVE", "drop": "DROPMALFORMED", "fail": "FAILFAST"}[malformed]
    return spark.read.schema(schema).option("mode", mode).json(path)


def raw_products(spark: SparkSession, path: str) -> DataFrame:
    return records(spark, path, schemas.RAW_PRODUCT)


def products(spark: SparkSession, path: str) -> DataFrame:
    return records(spark, path, schemas.PRODUCT)


def enriched_products(spark: SparkSession, path: str) -> DataFrame:
    return records(spark, path, schemas.ENRICHED)


def golden_records(spark: SparkSession, path: str) -> DataFrame:
    return records(spark, path, schemas.GOLDEN)


def article_dump(spark: SparkSession, path: str, row_tag: str = "page") -> DataFrame:
    """Rows ``(title, ns, id, text)`` of an article dump (plain or compressed XML)."""
    pages = spark.read.format("xml").option("rowTag", row_tag).schema(schemas.WIKI_XML).load(path)
    return pages.select("title", "ns", "id", F.col("revision.text._VALUE").alias("text"))


def line_log(spark: SparkSession, path: str) -> DataFrame:
    """The distinct non-blank lines of an append-only log, as ``url``."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"))
    return lines.where("url != ''").distinct()


def push_log(spark: SparkSession, path: str) -> DataFrame:
    """The distinct non-blank lines of an append-only log in the order of their first line (files by name), as ``(url, at)`` with ``at`` from 1."""
    from ..operators.extract import with_serial

    lines = spark.read.text(path).select(F.trim("value").alias("url"), F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n")).alias("line"))
    first = lines.where("url != ''").groupBy("url").agg(F.min("line").alias("line")).select("url", "line.*")
    return with_serial(first, ["file_path", "file_block_start", "n"], "at").select("url", "at")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of every file, contents unread."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def config(*paths: str) -> dict:
    """JSON objects merged, later files over earlier ones."""
    out: dict = {}
    for p in paths:
        out |= json.loads(Path(p).read_text(encoding="utf-8"))
    return out
