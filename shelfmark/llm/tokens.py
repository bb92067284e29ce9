"""Sizes in tokens of a public tokenizer, and exact ranks and offsets within groups of any size."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, ship

#: Vocabulary file (tiktoken ranks); a parameter of every operator that measures texts.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-tokenisation pattern of byte-level BPE vocabularies of this family.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows that one window task may hold.
GROUP = 100_000


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def sized(df: DataFrame, text: str = "text", to: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with the size of each whole text in tokens; a null text has none.

    The vocabulary file is read on the driver and broadcast (under 2 MB, whatever the data).
    """
    spark = df.sparkSession
    ship(spark)
    ranks = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(ranks.value)
        for batch in batches:
            yield pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in batch], dtype="int64")

    sizes.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(to, F.pandas_udf(sizes, "bigint")(F.col(text)))


def offset_within(df: DataFrame, key: str, order: list[str], amount: str | None, n_rows: int, to: str) -> DataFrame:
    """``df`` with the exact exclusive running sum of ``amount`` (or the 0-based rank) within ``key``, as column ``to``.

    A group may hold any share of the rows: it is cut into salts of about ``GROUP`` rows by a
    hash of the order columns, summed within each salt by a window, and moved by the total
    of the salts before it, which is a window over one row per (key, salt).
    """
    salts = max(1, -(-n_rows // GROUP))
    add = F.col(amount) if amount else F.lit(1).cast("bigint")
    cut = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    totals = cut.groupBy(key, "_salt").agg(F.sum(add).alias("_t"))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(key).alias("_k"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("_in", F.coalesce(F.sum(add).over(inside), F.lit(0)))
    joined = cut.join(starts, (F.col(key) == F.col("_k")) & (F.col("_salt") == F.col("_s")))
    return joined.withColumn(to, F.col("_start") + F.col("_in")).drop("_salt", "_in", "_k", "_s", "_start")


def measured(df: DataFrame, columns: list[str], text: str, vocabulary: str) -> DataFrame:
    """Only ``columns`` and ``n_tokens``, checkpointed: texts are tokenised once however often sizes are used."""
    return checkpointed(sized(df.select(*columns, text), text, "n_tokens", vocabulary).drop(text))
