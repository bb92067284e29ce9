"""Sinks: record files, Parquet, single files, logs and index tables."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_records(df: DataFrame, path: str) -> None:
    """Newline-delimited JSON, overwritten; null fields are left out of the objects."""
    df.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_single(df: DataFrame, path: str) -> None:
    """One record file, for an export. The data pass one task, but no stage before it is narrowed."""
    df.repartition(1).write.mode("overwrite").json(path)


def append_log(urls: DataFrame, path: str) -> None:
    """One address a line, appended."""
    urls.select(F.col(urls.columns[0]).cast("string").alias("value")).write.mode("append").text(path)


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def merge_parts(spark: SparkSession, source: str, path: str) -> None:
    """Part files as one text file, blank lines dropped."""
    spark.read.text(source).where("trim(value) <> ''").repartition(1).write.mode("overwrite").text(path)


def remove(spark: SparkSession, path: str) -> None:
    """A folder, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def output_megabytes(spark: SparkSession, path: str) -> float:
    """Size of an output folder, from the file system's summary."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return round(fs.getContentSummary(p).getLength() / (1024 * 1024), 2)


#: Folders that the rows of an index table are spread over, by a checksum of their term.
BUCKETS = 32


def bucket_of(term: str) -> int:
    """The folder that holds a term."""
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def write_by_term(df: DataFrame, path: str) -> None:
    """An index table in folders by term, sorted within files: a query for few terms opens their folders only, and skips row groups there.

    Ranges are cut by document too, so that the postings of a frequent term are spread over several tasks.
    """
    keys = ["bucket", *(c for c in ("term", "field", "doc_id") if c in df.columns)]
    out = df.withColumn("bucket", F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(BUCKETS)).cast("int"))
    n = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("bucket").parquet(path)


def write_sorted(df: DataFrame, keys: list[str], path: str) -> None:
    """An index table in ranges of its keys, sorted within files: a look-up of few keys skips files and row groups by their bounds."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def holding(df: DataFrame, terms: list[str]) -> DataFrame:
    """The rows of these terms; tables in folders by term are pruned to the folders that hold them."""
    terms = sorted(set(terms))
    out = df.where(F.col("term").isin(terms))
    return out.where(F.col("bucket").isin(sorted({bucket_of(t) for t in terms}))) if "bucket" in df.columns else out


def read_index(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
