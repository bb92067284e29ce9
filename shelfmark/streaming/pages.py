"""Streams of crawl records and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract


def new_records(spark: SparkSession, folder: str, schema: str, fmt: str = "json") -> DataFrame:
    """Records of files that appear in a folder."""
    return spark.readStream.format(fmt).schema(schema).load(folder)


def first_visits(records: DataFrame, delay: str = "2 hours", at: str = "fetched_at") -> DataFrame:
    """The first record of every address within the watermark; the state forgets addresses older than ``delay``."""
    timed = records.withColumn("event_time", F.timestamp_seconds(at))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["url"])


def visits_per_window(records: DataFrame, window: str = "10 minutes", delay: str = "2 hours", at: str = "fetched_at") -> DataFrame:
    """Visits and errors by tumbling window; late rows count until the watermark has passed their window."""
    timed = records.withColumn("event_time", F.timestamp_seconds(at)).withWatermark("event_time", delay)
    out = timed.groupBy(F.window("event_time", window).alias("w")).agg(F.count("*").alias("visits"), F.count_if(F.col("status") != "ok").alias("failed"))
    return out.select(F.col("w.start").alias("window_start"), "visits", "failed")


def extracted(pages: DataFrame) -> DataFrame:
    """Complete raw products of a stream of pages; stateless."""
    return extract.complete(extract.raw_products(pages))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there, write it as Parquet, and stop; a rerun goes on after the last committed batch."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
