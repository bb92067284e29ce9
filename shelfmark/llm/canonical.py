"""Mapping freely typed values to a canonical list.

Values are deduplicated and normalised, candidates come from an inverted index of character
n-grams over the list, a weighted cosine scores them, and the best is accepted above a
threshold and with a margin to the next. Before that, an exact alignment of words within a small
edit distance confirms the few candidates whose cosine is near the best.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, ship

#: Rows of the list that one index holds; a longer list is cut into blocks, which share frequencies, threshold and margin.
BLOCK = 20_000
#: Values that are matched with one block of a longer list in one task.
PART = 50_000
#: Least cosine of a match, and least lead over the next confirmed entry.
THRESHOLD, MARGIN = 0.2, 0.02
#: Candidates have at least this share of the best cosine; among confirmed ones whose cosines are this near the best, fewer edits win.
NEAR, CLOSE = 0.7, 0.1
#: Buckets of the entry counts of features; the bound of what is known of a whole list.
BUCKETS = 1 << 18

# Characters that are typed for one another.
_LOOKALIKES = str.maketrans({"0": "o", "1": "i", "l": "i", "5": "s", "3": "e", "4": "a", "7": "t", "8": "b", "$": "s", "@": "a", "|": "i"})


def words(value: str) -> list[str]:
    """Folded words; apostrophes vanish, bracketed notes, percentages and marks are dropped, digits become the letters they are typed for."""
    value = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()
    value = re.sub(r"[®™©]|(?<=\w)tm\b(?=\s*$)|[­​-‏⁠﻿]|['’`´]", "", value.replace("™", ""))
    value = re.sub(r"\([^()]*\)|\d+(?:[.,]\d+)?\s*%", " ", value).replace("&", " and ")
    return [w.translate(_LOOKALIKES) for w in re.findall(r"[^\W_]+", value)]


def grams(ws: list[str]) -> Counter:
    """Weighted character features: padded bigrams and trigrams, gapped bigrams, pairs in either order and single letters of every word; a feature counts three times at most."""
    out: Counter = Counter()
    for w in ws:
        padded = f"^{w}$"
        for i in range(len(padded) - 1):
            out[padded[i : i + 2]] += 1.0
            if i < len(padded) - 2:
                out[padded[i : i + 3]] += 1.0
                out[f"{padded[i]}_{padded[i + 2]}"] += 0.7
        for x, y in (*zip(w, w[1:]), *zip(w, w[2:])):
            out[f"~{min(x, y)}{max(x, y)}"] += 0.7
        for c in w:
            out[c] += 0.3
    return Counter({g: min(x, 3.0) for g, x in out.items()})


def distance(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (letters may be swapped, dropped and added in any order), or ``most + 1`` where it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    spare = Counter(a)
    spare.subtract(b)
    if max(sum(x for x in spare.values() if x > 0), -sum(x for x in spare.values() if x < 0)) > most:
        return most + 1  # the letters alone differ by more
    far = len(a) + len(b)
    last: dict[str, int] = {}
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [far, i]
        seen = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            cost = 1
            if x == y:
                cost, seen = 0, j
            row.append(min(rows[i][j] + cost, row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        rows.append(row)
        last[x] = i
    return min(rows[-1][-1], most + 1)


def allowed(n: int) -> int:
    return 0 if n < 3 else 1 if n < 6 else 2 if n < 12 else 3


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS


def frequencies(entries: list[str]) -> Counter:
    """In how many entries features of each bucket are."""
    return Counter(b for e in entries for b in {bucket(g) for g in grams(words(e))})


def weak_words(entries: list[list[str]]) -> set[str]:
    """Words that several entries share and that never stand alone: they say little."""
    common = Counter(w for ws in entries for w in set(ws))
    alone = {ws[0] for ws in entries if len(ws) == 1}
    return {w for w, c in common.items() if c >= 3 and w not in alone}


class Index:
    """N-gram postings of a list of canonical entries, or of a block of a list of ``n`` whose ``counts`` and ``weak`` words are given."""

    def __init__(self, ids: list[int], entries: list[str], counts: dict[int, int] | None = None, n: int = 0, weak: set[str] | None = None):
        self.ids, self.words = ids, [words(e) for e in entries]
        vectors = [grams(w) for w in self.words]
        self.counts, self.n = (frequencies(entries), max(1, len(entries))) if counts is None else (counts, n)
        self.unknown = math.log(1 + self.n) * 0.5
        self.idfs: dict[str, float] = {}
        postings: dict[str, list[tuple[int, float]]] = {}
        for k, v in enumerate(vectors):
            norm = math.sqrt(sum((x * self.idf(g)) ** 2 for g, x in v.items())) or 1.0
            for g, x in v.items():
                postings.setdefault(g, []).append((k, x * self.idf(g) / norm))
        self.postings = {g: (np.array([k for k, _ in p]), np.array([x for _, x in p])) for g, p in postings.items()}
        self.weak = (weak_words(self.words) if weak is None else weak) | {"and"}

    def idf(self, gram: str) -> float:
        if (x := self.idfs.get(gram)) is None:
            c = self.counts.get(bucket(gram), 0)
            x = self.idfs[gram] = math.log(1 + self.n / c) if c else self.unknown
        return x

    def scores(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The entries that share a feature, and their cosines."""
        at, add = [], []
        norm = 0.0
        for g, x in grams(ws).items():
            w = x * self.idf(g)
            norm += w * w
            if (p := self.postings.get(g)) is not None:
                at.append(p[0])
                add.append(w * p[1])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0)
        sums = np.bincount(np.concatenate(at), np.concatenate(add))
        found = np.flatnonzero(sums)
        return found, sums[found] / math.sqrt(norm)

    def aligned(self, ws: list[str], k: int) -> int | None:
        """Total edits to align the telling words of entry ``k`` with words of the value, or None; a missing weak word costs one."""
        entry = self.words[k]
        telling = [w for w in entry if w not in self.weak] or entry
        best: int | None = None
        joined, target = "".join(ws), "".join(entry)
        if (d := distance(joined, target, allowed(len(target)))) <= allowed(len(target)):
            best = d
        if len(target) >= 6 and len(joined) > len(target):  # run together beside added words
            for i in range(len(ws)):
                for j in range(i + 1, min(len(ws), i + len(entry) + 1) + 1):
                    if (d := distance("".join(ws[i:j]), target, allowed(len(target)))) <= allowed(len(target)):
                        best = d if best is None else min(best, d)
        left, total = list(ws), 0

        def short(x: str, w: str) -> bool:
            """Whether ``x`` abbreviates ``w``, one of several words."""
            return len(telling) > 1 and 3 <= len(x) < len(w) - 1 and w.startswith(x)

        for w in sorted(telling, key=len, reverse=True):
            most = allowed(len(w))
            pick = min(((1 if short(x, w) else distance(x, w, most), i) for i, x in enumerate(left)), default=(most + 1, 0))
            if pick[0] > most:
                return best
            total += pick[0]
            left.pop(pick[1])
        total += sum(w not in ws for w in entry if w in self.weak and w != "and")
        return total if best is None else min(best, total)

    def confirmed(self, value: str, threshold: float) -> tuple[float, list[tuple[float, int, int]]]:
        """The best cosine of any entry, and the candidates near it whose words align, as (cosine, edits, entry id)."""
        ws = words(value)
        found, cosine = self.scores(ws)
        if not len(found):
            return 0.0, []
        top = float(cosine.max())
        good = []
        for k in np.flatnonzero(cosine >= max(threshold, NEAR * top)):
            if (d := self.aligned(ws, int(found[k]))) is not None:
                good.append((float(cosine[k]), d, self.ids[int(found[k])]))
        return top, good

    def match(self, value: str, threshold: float, margin: float) -> tuple[int, int, float] | None:
        """(entry id, edits, cosine) of the accepted candidate."""
        return accepted(*self.confirmed(value, threshold), margin)


def accepted(top: float, candidates: list[tuple[float, int, int]], margin: float) -> tuple[int, int, float] | None:
    """The candidate of the best cosine (of fewest edits among close ones), if it leads the next by the margin."""
    near = [c for c in candidates if c[0] >= NEAR * top]
    best = max((c[0] for c in near), default=0.0)
    close = [c for c in near if c[0] > best - CLOSE]
    few = sorted(((c, d, i) for c, d, i in close if d == min(x[1] for x in close)), reverse=True)
    if not few or len(few) > 1 and few[0][0] - few[1][0] < margin:
        return None
    return few[0][2], few[0][1], few[0][0]


def map_values(df: DataFrame, column: str, id_col: str, reference: DataFrame, ref_id: str, ref_value: str, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """Rows ``(id, value, ref_id)`` for every row whose value is neither null, blank nor literally an entry; ``ref_id`` -1 if unmatched.

    Ties between entries closer than the margin are reported as unmatched. Null and blank
    entries of the list match nothing; an empty list leaves all values unmatched; repeated rows
    give repeated results; long values are read whole; other columns are ignored.

    One shuffle deduplicates the values (map-side combined, so a hot value costs one row a
    task). A list of at most ``BLOCK`` rows is broadcast. A longer one is cut into blocks, and every part of
    the values meets every block in a task; all blocks use the frequencies of the whole list.
    """
    spark = df.sparkSession
    ship(spark)
    entries = reference.select(F.col(ref_id).cast("bigint").alias("_r"), F.col(ref_value).alias("_e")).where(F.length(F.trim("_e")) > 0)
    rows = df.select(F.col(id_col).alias("_id"), F.col(column).alias("_v")).where(F.length(F.trim(F.regexp_replace("_v", r"[\s\u00a0]+", " "))) > 0)
    rows = rows.join(entries.select(F.col("_e").alias("_v")).distinct(), "_v", "left_anti")
    values = rows.select("_v").distinct().repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    got = entries.orderBy("_r").limit(BLOCK + 1).toPandas()
    if len(got) <= BLOCK:
        shared = spark.sparkContext.broadcast((got["_r"].tolist(), got["_e"].tolist()))

        def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = Index(*shared.value)
            for batch in batches:
                yield pd.DataFrame([(v, m[0]) for v in batch["_v"] if (m := index.match(v, threshold, margin))], columns=["_v", "_m"])

        found = values.mapInPandas(matched, "_v string, _m bigint")
    else:
        found = _by_blocks(values, entries, threshold, margin)
    out = rows.join(found, "_v", "left")
    return out.select(F.col("_id").alias(id_col), F.col("_v").alias("value"), F.coalesce("_m", F.lit(-1)).cast("bigint").alias("ref_id"))


def _by_blocks(values: DataFrame, entries: DataFrame, threshold: float, margin: float) -> DataFrame:
    """Rows ``(_v, _m)``: values matched with a list of any length."""
    spark = values.sparkSession
    values = checkpointed(values)
    n, n_values = entries.count(), values.count()
    n_blocks, n_parts = -(-2 * n // BLOCK), -(-max(1, n_values) // PART)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for b in batches:
            counts.update(frequencies(b["_e"].tolist()))
        yield pd.DataFrame(list(counts.items()), columns=["b", "n"])

    counts = {r["b"]: r["n"] for r in entries.mapInPandas(counted, "b int, n bigint").groupBy("b").agg(F.sum("n").alias("n")).collect()}  # a row per bucket
    shared = spark.sparkContext.broadcast(counts)

    # Weak words of the whole list, beside each entry that has them.
    def split(entry: pd.Series) -> pd.Series:
        return entry.map(words)

    split.__annotations__ = {"entry": pd.Series, "return": pd.Series}
    each = entries.withColumn("_w", F.pandas_udf(split, "array<string>")("_e")).select("_r", F.explode(F.array_distinct("_w")).alias("w"), (F.size("_w") == 1).alias("alone"))
    weak = each.groupBy("w").agg(F.count("*").alias("n"), F.max("alone").alias("alone")).where("n >= 3 and not alone").select("w")
    weak = each.join(weak, "w").groupBy("_r").agg(F.collect_set("w").alias("_weak"))
    block = F.pmod(F.xxhash64("_r"), F.lit(n_blocks)).alias("_b")
    left = entries.join(weak, "_r", "left").select(block, F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("_p"), "_r", "_e", F.coalesce("_weak", F.array()).alias("_weak"))
    right = values.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_blocks - 1).cast("bigint"))).alias("_b"), F.pmod(F.xxhash64("_v"), F.lit(n_parts)).cast("int").alias("_p"), "_v")

    def matched(block: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(some):
            index = Index(block["_r"].tolist(), block["_e"].tolist(), shared.value, n, {w for ws in block["_weak"] for w in ws})
            for v in some["_v"]:
                top, good = index.confirmed(v, threshold)
                out += [(v, top, *c) for c in good] or [(v, top, None, None, None)]
        return pd.DataFrame(out, columns=["_v", "top", "c", "d", "r"]).astype({"d": "Int32", "r": "Int64"})

    near = left.groupBy("_b", "_p").cogroup(right.groupBy("_b", "_p")).applyInPandas(matched, "_v string, top double, c double, d int, r bigint")
    by_value = Window.partitionBy("_v")
    near = near.withColumn("top", F.max("top").over(by_value)).where(F.col("c") >= NEAR * F.col("top"))
    close = near.withColumn("best", F.max("c").over(by_value)).where(F.col("c") > F.col("best") - CLOSE)
    few = close.withColumn("few", F.min("d").over(by_value)).where("d = few").withColumn("lead", F.max("c").over(by_value))
    return few.where(F.col("lead") - F.col("c") < margin).groupBy("_v").agg(F.count("*").alias("n"), F.min("r").alias("_m")).where("n = 1").select("_v", "_m")
