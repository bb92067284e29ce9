"""Mixing sources to target weights by blocks, multinomial draws and index permutations.

The texts of each source are laid end to end and cut into blocks of a fixed number of
tokens. Every output shard draws how many of its slots each source fills; the slots of a
source are numbered through all shards, and slot ``k`` takes, in round ``k // blocks``, the
block that a keyed permutation of the source's block indices gives. A source is used at most
``max_repeats`` rounds; slots beyond that stay empty. The report states, beside the shares
reached, how many tokens of what was drawn are missing for that reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, ship
from . import tokens

BLOCK_TOKENS = 1024
SHARD_SLOTS = 1024
#: Shards whose counts one window task sums up.
EPOCH_SHARDS = 4096
_MASK = (1 << 64) - 1


def _round_key(seed: int, source: int, turn: int, step: int) -> int:
    x = (seed * 0x9E3779B97F4A7C15 + source * 0xBF58476D1CE4E5B9 + turn * 0x94D049BB133111EB + step * 0xD6E8FEB86659FD93 + 1) & _MASK
    x ^= x >> 31
    return (x * 0x94D049BB133111EB) & _MASK


def permuted(index: np.ndarray, size: int, seed: int, source: int, turn: int) -> np.ndarray:
    """A pseudorandom permutation of ``range(size)`` at ``index``: a four-step Feistel network with cycle walking."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(_round_key(seed, source, turn, step)) for step in range(4)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            with np.errstate(over="ignore"):
                f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            left, right = right, left ^ (f & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (outside := out >= np.uint64(size)).any():
        out[outside] = once(out[outside])
    return out.astype(np.int64)


class Mix:
    """The parts of one mixture: ``supply`` (one row per source), ``pieces`` of blocks, and drawn ``slots``."""

    def __init__(self, supply: DataFrame, pieces: DataFrame, slots: DataFrame, block_tokens: int):
        self.supply, self.pieces, self.slots, self.block_tokens = supply, pieces, slots, block_tokens

    def rows(self) -> DataFrame:
        """The mixture: ``(shard, slot, source, turn, block, id, first_token, n_tokens)``, joined by (source, block)."""
        return self.slots.where("filled").drop("filled").join(self.pieces, ["source", "block"])

    def report(self) -> DataFrame:
        """One row per source: target and actual share, what it holds, what was drawn, used and is missing, and whether it falls short.

        ``short``: the drawn slots use up all (or all but the scatter of the draws) that the source has within its repeats, and
        exactly so by size: all its texts, each used ``max_repeats`` times, stay below the target share of all sources' tokens.
        """
        block_tokens = self.pieces.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"))
        drawn = self.slots.groupBy("source").agg(F.count("*").alias("slots"), F.count(F.when(~F.col("filled"), 1)).alias("empty"))
        used = self.slots.where("filled").join(block_tokens, ["source", "block"]).groupBy("source").agg(F.sum("n").alias("used_tokens"), F.max(F.col("turn") + 1).alias("rounds"))
        out = self.supply.join(drawn, "source", "left").join(used, "source", "left").na.fill(0, ["slots", "empty", "used_tokens", "rounds"])
        all_used = F.sum("used_tokens").over(Window.partitionBy())  # a row per source
        scatter = 6 * F.sqrt(F.col("slots") + 1) + F.col("max_repeats") + 1  # in slots: of the draws, and of the last block of each round
        spent = F.col("used_tokens") + scatter * self.block_tokens >= F.col("tokens") * F.col("max_repeats")
        return out.select(
            "source", "target_share", "max_repeats", "tokens", "used_tokens", (F.col("empty") * self.block_tokens).alias("missing_tokens"), F.col("rounds").cast("bigint").alias("rounds"),
            F.round(F.coalesce(F.try_divide("used_tokens", all_used), F.lit(0.0)), 4).alias("actual_share"), (spent & F.col("below")).alias("short"),
        )

    def short_sources(self) -> DataFrame:
        """Sources that cannot reach their share, by the drawn mixture."""
        return self.report().where("short").select("source")


def mix(
    df: DataFrame, targets: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
    block_tokens: int = BLOCK_TOKENS, total_tokens: int | None = None, seed: int = 7, vocabulary: str = tokens.VOCABULARY,
) -> Mix:
    """A mixture of about ``total_tokens`` (by default the size of all texts of the target sources, each counted once).

    Texts of a null source or of a source without target take no part; null and empty texts have
    no tokens; repeated rows are texts of their own; a target whose source has no text falls
    short. Targets are one row per source (their number bounds all that reaches the driver);
    a target table without rows gives an empty mixture.
    """
    spark = df.sparkSession
    ship(spark)
    wanted = targets.select(F.col("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).where("source is not null")
    docs = df.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    docs = docs.join(F.broadcast(wanted.select("source").distinct()), "source", "left_semi")  # one row per source of the target table
    docs = tokens.measured(docs, ["id", "source", "_row"], "_text", vocabulary)
    held = docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("texts"))
    rows = wanted.join(held, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("texts", F.lit(0)).alias("texts")).collect()
    total = sum(r["tokens"] for r in rows)
    order = sorted(rows, key=lambda r: r["source"])
    schema = "source string, target_share double, max_repeats int, tokens bigint, below boolean"
    supply = spark.createDataFrame([(r["source"], r["target_share"], r["max_repeats"], r["tokens"], r["tokens"] * r["max_repeats"] < r["target_share"] * total) for r in order], schema)

    placed = tokens.offset_within(docs.where("n_tokens > 0"), "source", ["_row"], "n_tokens", sum(r["texts"] for r in rows), "_at")
    last = F.floor((F.col("_at") + F.col("n_tokens") - 1) / block_tokens)
    pieces = placed.select("source", "id", "_at", "n_tokens", F.explode(F.sequence(F.floor(F.col("_at") / block_tokens), last)).alias("block"))
    begin = F.greatest(F.col("_at"), F.col("block") * block_tokens)
    end = F.least(F.col("_at") + F.col("n_tokens"), (F.col("block") + 1) * block_tokens)
    pieces = pieces.select("source", "block", "id", (begin - F.col("_at")).alias("first_token"), (end - begin).alias("n_tokens"))

    n_slots = -(-(total_tokens if total_tokens is not None else total) // block_tokens)
    n_shards = -(-n_slots // SHARD_SLOTS)
    names = [r["source"] for r in order]
    shares = np.array([r["target_share"] for r in order], float)
    shares = shares / shares.sum() if len(shares) and shares.sum() > 0 else shares
    blocks = [-(-r["tokens"] // block_tokens) for r in order]
    repeats = [r["max_repeats"] for r in order]

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                size = min(SHARD_SLOTS, n_slots - int(shard) * SHARD_SLOTS)
                counts = np.random.default_rng([seed, int(shard)]).multinomial(size, shares)
                yield pd.DataFrame({"shard": int(shard), "k": np.arange(len(names)), "n": counts})

    draws = spark.range(n_shards).mapInPandas(drawn, "shard bigint, k int, n bigint") if len(names) else spark.createDataFrame([], "shard bigint, k int, n bigint")
    # Slots of a source are numbered through all shards: within epochs of shards, and by the totals of the epochs before.
    draws = draws.withColumn("epoch", F.floor(F.col("shard") / EPOCH_SHARDS))
    epochs = draws.groupBy("k", "epoch").agg(F.sum("n").alias("sum"))
    earlier = Window.partitionBy("k").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    epochs = epochs.select("k", "epoch", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start"))
    before = Window.partitionBy("k", "epoch").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    draws = draws.withColumns({"first": F.coalesce(F.sum("n").over(before), F.lit(0)), "slot": F.coalesce(F.sum("n").over(inside), F.lit(0))}).join(epochs, ["k", "epoch"])
    draws = checkpointed(draws.select("shard", "k", "n", (F.col("first") + F.col("start")).alias("first"), "slot"))

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, k, n, first, slot in batch[["shard", "k", "n", "first", "slot"]].itertuples(index=False):
                if not n:
                    continue
                size = blocks[k]
                ordinal = first + np.arange(n)
                turn = ordinal // max(1, size)
                filled = (turn < repeats[k]) & (size > 0)
                index = np.zeros(n, np.int64)
                for t in np.unique(turn[filled]):
                    now = filled & (turn == t)
                    index[now] = permuted(ordinal[now] % size, size, seed, int(k), int(t))
                yield pd.DataFrame({"shard": shard, "slot": slot + np.arange(n), "source": names[k], "turn": turn, "block": index, "filled": filled})

    slots = draws.mapInPandas(taken, "shard bigint, slot bigint, source string, turn bigint, block bigint, filled boolean")
    return Mix(supply, pieces, slots, block_tokens)
