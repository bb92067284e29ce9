"""The TF-IDF index as three tables, and ranked search on it."""

from __future__ import annotations

import functools
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import sinks


@dataclass(frozen=True)
class TfIdfIndex:
    postings: DataFrame  # term, doc_id, tf; written ones also l2 (of the document) and bucket
    terms: DataFrame  # term, n0, total_tf
    docs: DataFrame  # doc_id, doc_len, l2

    @functools.cached_property
    def n(self) -> int:
        """Number of documents; read once."""
        return self.docs.count()


def document_terms(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """``(doc_id, tokens)``: every text is tokenised once; all tables derive from this."""
    return df.select(F.col(id_col).alias("doc_id"), tx.tokenize(text).alias("tokens"))


def postings(tokens: DataFrame) -> DataFrame:
    return tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def terms(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("n0"), F.sum("tf").alias("total_tf"))


def idf(n: Column, n0: Column) -> Column:
    return F.log(n / n0)


def norms(posted: DataFrame, dictionary: DataFrame, n: int) -> DataFrame:
    """``(doc_id, l2)``: the norm of each document's TF-IDF vector, 0 if every term is in every document."""
    weight = F.col("tf") * idf(F.lit(float(n)), F.col("n0"))
    return posted.join(dictionary.select("term", "n0"), "term").groupBy("doc_id").agg(F.sqrt(F.sum(weight * weight)).alias("l2"))


def build(df: DataFrame, id_col: str, text: Column) -> TfIdfIndex:
    """Index of unique documents. ``l2`` is the norm of a document's TF-IDF vector: 0 without terms, or if every term is in every document."""
    tokens = document_terms(df, id_col, text)
    posted = postings(tokens)
    dictionary = terms(posted)
    lengths = tokens.select("doc_id", F.size("tokens").cast("bigint").alias("doc_len"))
    docs = lengths.join(norms(posted, dictionary, df.count()), "doc_id", "left").withColumn("l2", F.coalesce("l2", F.lit(0.0)))
    return TfIdfIndex(posted, dictionary, docs)


def write(df: DataFrame, id_col: str, text: Column, path: str) -> None:
    """The index as tables under ``path``. Texts are tokenised once; dictionary, norms and the final postings come from the written first ones."""
    spark = df.sparkSession
    sinks.write_table(postings(document_terms(df, id_col, text)), f"{path}/_draft")
    posted = spark.read.parquet(f"{path}/_draft")
    sinks.write_sorted(terms(posted), ["term"], f"{path}/terms")
    dictionary = spark.read.parquet(f"{path}/terms")
    lengths = posted.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))
    docs = df.select(F.col(id_col).alias("doc_id")).join(lengths, "doc_id", "left").join(norms(posted, dictionary, df.count()), "doc_id", "left")
    sinks.write_sorted(docs.na.fill(0, ["doc_len"]).na.fill(0.0, ["l2"]), ["doc_id"], f"{path}/docs")
    sinks.write_by_term(posted.join(spark.read.parquet(f"{path}/docs").select("doc_id", "l2"), "doc_id"), f"{path}/postings")
    sinks.remove(spark, f"{path}/_draft")


def read(spark: SparkSession, path: str) -> TfIdfIndex:
    return TfIdfIndex(**sinks.read_index(spark, path, ["postings", "terms", "docs"]))


def query_terms(query: str) -> list[str]:
    """Tokens of a query, in order; repeats are kept and count again."""
    return [t.lower() for t in re.findall(tx.TERM, query)]


def search(index: TfIdfIndex, query: str, mode: str = "idf", k: int = 10) -> DataFrame:
    """``(doc_id, score)``, the ``k`` best; ties in document order. Unknown tokens add nothing.

    The dictionary rows of the query's tokens are read first (one row a token). Then one pruned scan of
    the postings is left, of which only partial sums are shuffled.
    """
    if mode not in ("idf", "idf_l2"):
        raise ValueError(f"unknown mode {mode!r}")
    wanted = query_terms(query)
    known = {r["term"]: r["n0"] for r in sinks.holding(index.terms, wanted).select("term", "n0").collect()} if wanted else {}
    if not known:
        return index.postings.where("false").select("doc_id", F.lit(0.0).alias("score"))
    weight = F.lit(0.0)
    for t, n0 in known.items():
        weight = F.when(F.col("term") == t, wanted.count(t) * math.log(index.n / n0)).otherwise(weight)
    hits = sinks.holding(index.postings, list(known))
    raw = F.sum(F.col("tf") * weight).alias("raw")
    if mode == "idf":
        out = hits.groupBy("doc_id").agg(raw).select("doc_id", F.col("raw").alias("score"))
    else:
        scored = hits.groupBy("doc_id").agg(raw, F.first("l2").alias("l2")) if "l2" in hits.columns else hits.groupBy("doc_id").agg(raw).join(index.docs.select("doc_id", "l2"), "doc_id")
        out = scored.select("doc_id", F.coalesce(F.try_divide("raw", F.nullif("l2", F.lit(0.0))) * 100, F.lit(0.0)).alias("score"))
    return out.select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def with_metadata(hits: DataFrame, meta: DataFrame, id_col: str) -> DataFrame:
    """Hits joined to their documents' metadata, ranked from 1; hits without metadata drop out."""
    from pyspark.sql import Window

    joined = hits.join(meta.withColumnRenamed(id_col, "doc_id"), "doc_id")
    return joined.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))  # at most k rows
