"""Duplicates hidden by formatting: one class per record whatever its case, spacing, punctuation or part order.

Code points stream through a skip-and-fold lookup table straight into polynomial hashes, one
per word; a record's hash is the sum of its mixed word hashes, so the order of parts is
lost, and no canonical string is ever built. Composed letters and letter plus combining
mark fold to the same value at the same position. Rows whose hashes meet are then compared
with their representative by two pointers that skip what the table skips; rows that fail
(true collisions) are hashed again with another seed until none is left.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ship

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MARK = np.uint64(0x100000001B3)
_BREAK = np.uint32(0xFFFFFFFF)
_APOSTROPHES = "'`´ʼ‘’"
#: Rows of one part of a group whose pairs are listed.
PAIR_ROWS = 1000


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = sys.maxunicode + 1
    return np.full(size, _BREAK, np.uint32), np.zeros(size, np.uint32), np.zeros(size, np.uint8), np.zeros(size, bool)


def fold_table(codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: folded base (0 skips, ``_BREAK`` ends a word), sum of combining marks, and kind (1 digit, 2 letter).

    Right for the code points of ``codes`` (by default all) and those asked for before; filled when they are first met.
    """
    base, mark, kind, known = _tables()
    asked = np.ones(len(known), bool)
    if codes is not None:
        asked[:] = False
        asked[codes] = True
    for cp in np.flatnonzero(asked & ~known).tolist():
        known[cp] = True
        c = chr(cp)
        cat = unicodedata.category(c)
        if cat in ("Cn", "Co", "Cs"):
            continue
        if cat[0] == "M":
            base[cp], mark[cp] = 0, cp
        elif cat == "Cf" or c in _APOSTROPHES:
            base[cp] = 0
        elif cat[0] in "LN":
            parts = unicodedata.normalize("NFD", c.lower())
            base[cp] = ord(parts[0])
            mark[cp] = sum(ord(x) for x in parts[1:]) & 0xFFFFFFFF
            kind[cp] = 1 if cat == "Nd" else 2
    return base, mark, kind


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream_hash(texts: list[str], parts: bool, seed: int) -> np.ndarray:
    """One 64-bit hash per text; 0 where a text has no content.

    ``parts``: words are hashed apart and their order is disregarded (a number and the unit
    after it are two words); otherwise the text is one word and only skipping and folding apply.
    """
    n = len(texts)
    out = np.zeros(n, np.uint64)
    lengths = np.fromiter((len(t) for t in texts), np.int64, n)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return out
    table, marks, kinds = fold_table(codes)
    row = np.repeat(np.arange(n), lengths)
    base, mark, kind = table[codes], marks[codes].astype(np.uint64), kinds[codes]
    same_row = np.concatenate(([False], row[1:] == row[:-1]))
    if parts:
        digit = kind == 1
        left = np.concatenate(([False], digit[:-1])) & same_row
        right = np.concatenate((digit[1:] & same_row[1:], [False]))
        point = (codes == ord(".")) & left & right
        base, kind = np.where(point, np.uint32(ord(".")), base), np.where(point, np.uint8(1), kind)
    broken = (base == _BREAK) | (base == 0) & (mark == 0)
    if not parts:
        kept = ~broken
    else:
        # A skipped code point neither counts nor ends a word: drop those first, then cut words.
        kept = base != 0
        kept |= mark != 0
    base, mark, kind, row = base[kept], mark[kept], kind[kept], row[kept]
    if not len(base):
        return out
    new_row = np.concatenate(([True], row[1:] != row[:-1]))
    if parts:
        stop = base == _BREAK
        solid = base != 0
        last_kind = np.where(solid, kind, 0)
        # kind of the last base before each code point (combining marks take that of their base)
        at = np.maximum.accumulate(np.where(solid, np.arange(len(base)), 0))
        before = np.concatenate(([0], last_kind[at][:-1]))
        start = new_row | stop | np.concatenate(([True], stop[:-1])) | (solid & (kind != before) & (before != 0) & ~stop)
    else:
        stop, start = np.zeros(len(base), bool), new_row
    word = np.cumsum(start) - 1
    first = np.flatnonzero(start)
    step = np.cumsum(((base != 0) & ~stop).astype(np.int64))
    place = np.maximum(step - (step[first] - ((base[first] != 0) & ~stop[first]))[word] - 1, 0)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(place.max()) if len(place) else 0, _BASE + np.uint64(2 * seed)))))
        value = np.where(stop, 0, base).astype(np.uint64) + mark * _MARK
        words = np.add.reduceat(value * powers[place], first)
        real = np.add.reduceat((~stop & (base != 0)).astype(np.int64), first) > 0
        mixed = np.where(real, _mix(words + np.uint64(seed + 1) * np.uint64(0xD6E8FEB86659FD93)), np.uint64(0))
        np.add.at(out, row[first], mixed)
    return out


@functools.lru_cache(maxsize=100_000)
def _fold(c: str) -> tuple[int, int, int]:
    base, mark, kind = fold_table(np.array([ord(c)]))
    return int(base[ord(c)]), int(mark[ord(c)]), int(kind[ord(c)])


def _folded(text: str, at: int, parts: bool) -> tuple[int, int, int]:
    """Folded base, marks and kind of one code point; a decimal point between digits counts as a digit."""
    c = text[at]
    if c == "." and parts and 0 < at < len(text) - 1 and _fold(text[at - 1])[2] == 1 and _fold(text[at + 1])[2] == 1:
        return 46, 0, 1
    return _fold(c)


def _next(text: str, at: int, end: int, parts: bool) -> tuple[int, int, int, bool, int]:
    """The next unit from ``at`` on: its base, marks and kind, whether a break was skipped before it, and where it ends; base 0 at the end."""
    broken = False
    while at < end:
        base, mark, kind = _folded(text, at, parts)
        at += 1
        if base == _BREAK:
            broken = True
        elif base:
            while at < end:  # combining marks, and what is skipped among them
                b, m, _ = _folded(text, at, parts)
                if b:
                    break
                mark += m
                at += 1
            return base, mark, kind, broken, at
    return 0, 0, 0, broken, at


def _same_span(a: str, i: int, i_end: int, b: str, j: int, j_end: int, parts: bool, words: bool) -> bool:
    """Two pointers over two stretches, each skipping what the table skips; with ``words`` they must break into words at the same places."""
    kind = 0
    while True:
        x, xm, xk, x_broken, i = _next(a, i, i_end, parts)
        y, ym, yk, y_broken, j = _next(b, j, j_end, parts)
        if x != y or xm != ym:
            return False
        if not x:
            return True
        if words and kind and xk == yk == kind and x_broken != y_broken:
            return False
        kind = xk


def _word_spans(text: str) -> list[tuple[int, int, int]]:
    """(hash, start, end) of every word; only the spans are kept."""
    out: list[tuple[int, int, int]] = []
    at, last, h, start = 0, 0, 0, 0
    while True:
        base, mark, kind, broken, end = _next(text, at, len(text), True)
        if last and (not base or broken or kind != last):
            out.append((h, start, at))
            h = 0
        if not base:
            return sorted(out)
        if not h:
            start = at
        h = (h * 0x100000001B3 + base * 31 + mark + 1) & 0xFFFFFFFFFFFFFFFF
        at, last = end, kind


def same_content(a: str, b: str, parts: bool) -> bool:
    """Two pointers over both texts, skipping what the table skips; with ``parts`` the words may be permuted.

    Permuted words are paired by their hashes and every pair is compared by two pointers in place.
    """
    if a == b or _same_span(a, 0, len(a), b, 0, len(b), parts, parts):
        return True
    if not parts:
        return False
    x, y = _word_spans(a), _word_spans(b)
    return len(x) == len(y) and all(h == g and _same_span(a, i, i_end, b, j, j_end, True, False) for (h, i, i_end), (g, j, j_end) in zip(x, y))


def _hashes(seed: int):
    def hashes(name: pd.Series, source: pd.Series) -> pd.DataFrame:
        a, b = name.fillna("").tolist(), source.fillna("").tolist()
        n1, n2, s = stream_hash(a, True, seed), stream_hash(a, True, seed + 1), stream_hash(b, False, seed)
        with np.errstate(over="ignore"):
            h1, h2 = _mix(n1 + s * np.uint64(3)), _mix(n2 * np.uint64(5) + s)
        empty = (n1 == 0) | (s == 0)
        return pd.DataFrame({"h1": np.where(empty, np.uint64(0), h1).view(np.int64), "h2": np.where(empty, np.uint64(0), h2).view(np.int64)})

    return F.pandas_udf(hashes, "h1 bigint, h2 bigint")


def _same(name: pd.Series, source: pd.Series, name2: pd.Series, source2: pd.Series) -> pd.Series:
    return pd.Series([same_content(a, c, True) and same_content(b, d, False) for a, b, c, d in zip(name, source, name2, source2)], dtype=bool)


def copy_classes(df: DataFrame, id_col: str = "product_id", name: str = "name", source: str = "source_file") -> DataFrame:
    """Rows ``(id, class_id)``, one per record; ``class_id`` is the smallest id of the record's class.

    A field without content (null, blank, only punctuation) agrees with nothing, so such
    a record is a class of its own. Ids should be unique; rows that repeat an id fall into the
    classes of their contents. Other columns are ignored; an empty table gives an empty result.

    One shuffle groups the hashes (map-side combined, so a hot class costs one row a task); the
    join back is an equi-join with one row per key on the other side, which adaptive execution
    splits when a class is hot. A copy of a text equal byte for byte is compared in one step.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).alias("_id"), F.col(name).alias("_a"), F.col(source).alias("_b"))
    done: DataFrame | None = None
    seed = 0
    while True:
        hashed = rows.withColumn("_h", _hashes(seed)("_a", "_b")).select("_id", "_a", "_b", F.col("_h.h1").alias("_h1"), F.col("_h.h2").alias("_h2"))
        keyed = checkpointed(hashed.where("_h1 != 0 or _h2 != 0"))  # hashed once, read by the grouping and the join
        firsts = keyed.groupBy("_h1", "_h2").agg(F.min(F.struct("_id", "_a", "_b")).alias("_r"), F.count("*").alias("_n")).where("_n > 1")
        met = keyed.join(firsts, ["_h1", "_h2"])
        checked = met.select("_id", F.col("_r._id").alias("_class"), F.pandas_udf(_same, "boolean")("_a", "_b", "_r._a", "_r._b").alias("_ok"))
        checked = checkpointed(checked)
        found = checked.where("_ok").select("_id", "_class")
        done = found if done is None else done.unionByName(found)
        failed = checked.where("not _ok").select("_id").distinct()
        if failed.isEmpty():
            break
        rows = rows.join(failed, "_id", "left_semi")
        seed += 16
    classes = df.select(F.col(id_col).alias("_id")).join(done.distinct(), "_id", "left")
    return classes.select(F.col("_id").alias(id_col), F.coalesce("_class", "_id").alias("class_id"))


def collapsed(df: DataFrame, id_col: str = "product_id", name: str = "name", source: str = "source_file") -> DataFrame:
    """Rows ``(class_id, copies)``: one record for each class, with the number of its copies (1 if unique)."""
    return copy_classes(df, id_col, name, source).groupBy("class_id").agg(F.count("*").alias("copies"))


def pairs_within(members: DataFrame, id_col: str, group: str, apart: str | None = None, most: int = PAIR_ROWS) -> DataFrame:
    """Rows ``(id_a, id_b)``, ``id_a < id_b``: every pair of each group, less those equal in ``apart``.

    A group of more than ``most`` rows is cut into k parts of about ``most`` rows, and every two
    parts are joined under a key of their own, so that no task holds more than two parts however
    large the group is. All pairs come out.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("_n")).where("_n > 1").select(group, F.ceil(F.col("_n") / most).cast("int").alias("_k"))
    rows = members.join(sizes, group).withColumn("_part", F.pmod(F.xxhash64(id_col), F.col("_k")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_k") - 1))
    side = lambda s, i, j: rows.select(group, i.alias("_i"), j.alias("_j"), *(F.col(c).alias(f"{c}_{s}") for c in (id_col, *([apart] if apart else []))))
    pairs = side("a", F.col("_part"), every).join(side("b", every, F.col("_part")), [group, "_i", "_j"]).where(F.col(f"{id_col}_a") < F.col(f"{id_col}_b"))
    if apart:
        pairs = pairs.where(~F.col(f"{apart}_a").eqNullSafe(F.col(f"{apart}_b")))
    return pairs.select(f"{id_col}_a", f"{id_col}_b")


def copy_pairs(df: DataFrame, id_col: str = "product_id", name: str = "name", source: str = "source_file") -> DataFrame:
    """Rows ``(id_a, id_b)``, ``id_a < id_b``: the pairs within each class; a repeated id pairs once."""
    return pairs_within(checkpointed(copy_classes(df, id_col, name, source).distinct()), id_col, "class_id")
