"""Filling fixed-capacity containers: a configuration LP over the length histogram.

The histogram has at most ``capacity`` rows whatever the data, so the plan is made on the
driver. Lengths form classes of about equal weight; multiplicative weights solve the covering LP
over configurations (multisets of classes that fit one container), each step pricing the best
configuration by a bounded knapsack dynamic program, until the dual bound is near. The
averaged solution is rounded with the error carried on, and each configuration takes the lengths
of its classes that fill its containers best. What rounding leaves is solved again, the last
few items go largest first. Items then find their container by their exact rank within their
length, so no group of items is ever gathered in one task.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ship
from . import tokens

#: Classes of lengths, cells of the knapsack, and most steps of a solution.
CLASSES, CELLS, STEPS = 40, 1024, 160
#: The steps end when the average solution covers all but this share at the cost of the bound.
GAP = 0.01
#: Share of a container that a configuration must fill with the lengths left, in the first solution and the next ones; else its items go to the next.
FULL = (0.997, 0.995, 0.99, 0.98, 0.95)


def price(sizes: np.ndarray, worth: np.ndarray, most: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Counts by class of the configuration of greatest worth with at most ``most`` of each, and its worth: a knapsack DP over binary parts."""
    best = np.zeros(capacity + 1)
    parts: list[tuple[int, int, np.ndarray]] = []
    for k in range(len(sizes)):
        left, part = min(int(most[k]), capacity // int(sizes[k])), 1
        while left > 0:
            part = min(part, left)
            room = capacity + 1 - part * int(sizes[k])
            taken = best[:room] + part * worth[k]
            better = taken > best[capacity + 1 - room :]
            best[capacity + 1 - room :][better] = taken[better]
            parts.append((k, part, better))
            left -= part
            part *= 2
    counts = np.zeros(len(sizes), np.int64)
    c = int(best.argmax())
    for k, part, better in reversed(parts):
        at = c - part * int(sizes[k])
        if at >= 0 and better[at]:
            counts[k] += part
            c = at
    return counts, float(best.max())


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = STEPS, gap: float = GAP) -> list[tuple[np.ndarray, float]]:
    """The covering LP by multiplicative weights: configurations (counts by class) and how often each is used, a fraction."""
    need = demand.astype(float)
    low = max(1.0, float((need * sizes).sum()) / capacity)
    steps = int(min(steps, max(8.0, low)))
    cover = np.zeros(len(sizes))
    used: dict[bytes, list] = {}
    bound = 0.0
    for t in range(1, steps + 1):
        # A class's weight falls exponentially with how far its coverage is ahead.
        ahead = cover - cover.min()
        weight = np.exp(-np.minimum(50.0, 12.0 * ahead)) * sizes
        counts, worth = price(sizes, weight, demand, capacity)
        bound = max(bound, float((weight * need).sum()) / worth)
        used.setdefault(counts.tobytes(), [counts, 0])[1] += 1
        cover += counts * (low / steps) / need
        if 2 * t >= steps and cover.min() * steps >= (1 - gap) * t:  # the average covers all, at the cost of the bound
            break
    scale = max(low, bound * (1 - gap)) / t
    return [(counts, times * scale) for counts, times in used.values()]


class _Stock:
    """Items by class and length that are still to be placed."""

    def __init__(self, lengths: np.ndarray, total: np.ndarray, classes: np.ndarray):
        self.class_of = dict(zip(lengths.tolist(), classes.tolist()))
        self.left = {n: x for n, x in zip(lengths.tolist(), total.tolist()) if x > 0}
        self.lengths: list[list[int]] = [[] for _ in range(int(classes.max()) + 1)]
        for n in sorted(self.left):
            self.lengths[self.class_of[n]].append(n)
        self.count = [sum(self.left[n] for n in ns) for ns in self.lengths]

    def take(self, items: dict[int, int], times: int) -> None:
        for n, c in items.items():
            k = self.class_of[n]
            self.left[n] -= c * times
            self.count[k] -= c * times
            if not self.left[n]:
                del self.left[n]
                self.lengths[k].pop(bisect.bisect_left(self.lengths[k], n))

    def pick(self, k: int, target: float, space: int, held: dict[int, int]) -> int | None:
        """The longest item of a class up to ``target``, else the shortest that fits the space."""
        ns = self.lengths[k]
        for i in range(bisect.bisect_right(ns, min(target, space)) - 1, -1, -1):
            if self.left[ns[i]] > held.get(ns[i], 0):
                return ns[i]
        for i in range(bisect.bisect_right(ns, min(target, space)), len(ns)):
            if ns[i] > space:
                return None
            if self.left[ns[i]] > held.get(ns[i], 0):
                return ns[i]
        return None


def _filled(stock: _Stock, counts: np.ndarray, means: np.ndarray, capacity: int, free: list[int]) -> dict[int, int]:
    """Lengths for one container of a configuration; what space is left is filled with the longest free items (``free`` by class)."""
    items: dict[int, int] = {}
    space = capacity
    order = [k for k in np.argsort(-means) if counts[k]]
    later = float((counts * means).sum())
    for k in order:
        k = int(k)
        for c in range(int(counts[k]), 0, -1):
            later -= means[k]
            # The space of this class is shared evenly among its items.
            n = stock.pick(k, (space - later + (c - 1) * means[k]) / c if c > 1 else space - later, space, items)
            if n is None:
                continue
            items[n] = items.get(n, 0) + 1
            space -= n
    held = [0] * len(free)
    while space > 0:
        best = None
        for k in range(len(free) - 1, -1, -1):
            if free[k] > held[k] and stock.lengths[k] and stock.lengths[k][0] <= space and (n := stock.pick(k, space, space, items)) is not None and (best is None or n > best):
                best = n
        if best is None:
            break
        items[best] = items.get(best, 0) + 1
        held[stock.class_of[best]] += 1
        space -= best
    return items


def greedy(lengths: np.ndarray, most: np.ndarray, space: int) -> np.ndarray:
    counts = np.zeros(len(lengths), np.int64)
    for k in range(len(lengths) - 1, -1, -1):
        if lengths[k] <= space and most[k] > 0:
            counts[k] = min(int(most[k]), space // int(lengths[k]))
            space -= int(counts[k] * lengths[k])
    return counts


def _greedy_plan(lengths: np.ndarray, rest: np.ndarray, capacity: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Largest items first, a configuration at a time; each uses up at least one length down to less than its count."""
    out = []
    while rest.any():
        counts = greedy(lengths, rest, capacity)
        some = counts > 0
        fit = int((rest[some] // counts[some]).min())
        out.append((lengths[some], counts[some], fit))
        rest = rest - counts * fit
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Configurations as (lengths, counts of each, times used); together they hold every item exactly once."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(n)] for n in lengths], np.int64)
    # Alone: what shares a container with nothing.
    alone = lengths + lengths[0] > capacity
    out = [(np.array([n]), np.array([1]), int(x)) for n, x in zip(lengths[alone], left[alone])]
    lengths, left = lengths[~alone], left[~alone]
    for full in FULL:
        if (left * lengths).sum() < 4 * capacity:
            break
        placed = _placed_by_lp(lengths, left, capacity, full)
        for n, c, times in placed:
            left[np.searchsorted(lengths, n)] -= c * times
        out += placed
    return out + _greedy_plan(lengths, left, capacity)


def _placed_by_lp(lengths: np.ndarray, left: np.ndarray, capacity: int, least: float) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """One solution of the LP, rounded: as plan, for most of the items."""
    mass = np.cumsum(left * lengths)
    classes = np.unique(np.minimum(CLASSES - 1, (mass - left * lengths / 2) * CLASSES // mass[-1]), return_inverse=True)[1]
    demand = np.bincount(classes, left).astype(np.int64)
    weight = np.bincount(classes, left * lengths)
    some = demand > 0
    means = np.where(some, weight / np.maximum(1, demand), 0)
    unit = max(1.0, capacity / CELLS)
    sizes = np.maximum(1, np.rint(means[some] / unit)).astype(np.int64)
    solution = solve(sizes, demand[some], int(capacity / unit))
    stock = _Stock(lengths, left, classes)
    wanted = []
    carried = 0.0
    for counts, times in sorted(solution, key=lambda u: -u[1]):
        whole = int(carried + times + 1e-9)
        carried += times - whole
        if whole > 0:
            full = np.zeros(len(demand), np.int64)
            full[some] = counts
            wanted.append((full, whole))
    reserved = sum((c * t for c, t in wanted), np.zeros(len(demand), np.int64))
    out = []
    for counts, times in wanted:
        reserved = reserved - counts * times
        while times > 0:
            free = [max(0, stock.count[k] - int(reserved[k] + counts[k] * times)) for k in range(len(demand))]
            items = _filled(stock, counts, means, capacity, free)
            used = sum(n * c for n, c in items.items())
            if used < least * capacity:  # too few of its lengths are left: to the next solution
                break
            fit = min(times, *(stock.left[n] // c for n, c in items.items()))
            stock.take(items, fit)
            ns = np.array(sorted(items), np.int64)
            out.append((ns, np.array([items[int(n)] for n in ns], np.int64), fit))
            times -= fit
    return out


def pack(df: DataFrame, capacity: int, id_col: str = "doc_id", text: str = "text", vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """Rows ``(id, piece, first_token, n_tokens, container_id)``; every text whole, unless larger than a container.

    A larger text gives full pieces of ``capacity`` tokens and one rest. Texts without tokens
    (null or empty) take no space and come out with a null container. Repeated rows are
    items of their own; an empty table gives an empty result; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    spark = df.sparkSession
    ship(spark)
    docs = tokens.measured(df.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row")), ["_id", "_row"], "_text", vocabulary)
    pieces = docs.where("n_tokens > 0").select("_id", "_row", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_tokens") - 1) / capacity))).alias("piece"))
    pieces = pieces.select("_id", "_row", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("bigint"), F.col("n_tokens") - F.col("piece") * capacity).alias("size"))
    histogram = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    base = 0
    for lengths, counts, times in plan(histogram, capacity):
        for n, c in zip(lengths.tolist(), counts.tolist()):
            start = taken.get(n, 0)
            slots.setdefault(n, []).append((start, c, base))
            taken[n] = start + c * times
        base += times
    shared = spark.sparkContext.broadcast({n: np.array(s, np.int64) for n, s in slots.items()})

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = shared.value
        for batch in batches:
            container = np.zeros(len(batch), np.int64)
            size, rank = batch["n_tokens"].to_numpy(), batch["rank"].to_numpy()
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                s = at[int(n)]
                k = np.searchsorted(s[:, 0], rank[rows], side="right") - 1
                container[rows] = s[k, 2] + (rank[rows] - s[k, 0]) // s[k, 1]
            yield batch.assign(container_id=container).drop(columns="rank")

    ranked = tokens.offset_within(pieces, "size", ["_row", "piece"], None, sum(histogram.values()), "rank")
    ranked = ranked.select(F.col("_id").cast("string").alias("id"), "piece", "first_token", F.col("size").alias("n_tokens"), "rank")
    out = ranked.mapInPandas(placed, "id string, piece bigint, first_token bigint, n_tokens bigint, container_id bigint").withColumn("id", F.col("id").cast(docs.schema["_id"].dataType))
    nothing = docs.where("n_tokens = 0").select(F.col("_id").alias("id"), F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("first_token"), "n_tokens", F.lit(None).cast("bigint").alias("container_id"))
    return out.unionByName(nothing).withColumnRenamed("id", id_col)


def split_texts(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids of the texts that were split: their pieces lie in several containers. (Repeated small rows of an id lie apart too, but are one piece each.)"""
    by = packed.groupBy(id_col).agg(F.max("piece").alias("_p"), F.min("container_id").alias("_a"), F.max("container_id").alias("_b"))
    return by.where("_p > 0 and _a < _b").select(id_col)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, items, tokens, and the share of the space that is used."""
    by = checkpointed(packed.where("container_id is not null").groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items")))
    return by.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.coalesce(F.max("used"), F.lit(0)).alias("fullest"),
        F.round(F.try_divide(F.sum("used"), F.count("*") * F.lit(capacity)), 4).alias("fill"),
    )
