"""Several values packed in one field: segmentation learned by expectation-maximisation.

Every field becomes a lattice. Atoms are the stretches between possible delimiters; brackets,
quoted spans and numbers are never cut. A path through the lattice chooses, at each
delimiter, whether it splits. Its likelihood is the product of the value probabilities and
of the split (or no-split) probabilities of the delimiter classes passed. Both are learned
from the whole column by forward-backward passes; Viterbi then gives the likeliest path.

The value frequencies live in a count-min sketch of ``ROWS * BUCKETS`` cells. Its size is
fixed, so the driver may hold it and broadcast it whatever the number of rows: each partition
reduces its expected counts to at most that many cells before the shuffle.
"""

from __future__ import annotations

import functools
import hashlib
import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Cells of the sketch of value counts; 3 MB as float64, the bound of what is broadcast and of what the driver gets.
ROWS, BUCKETS = 3, 1 << 17
_CELLS = ROWS * BUCKETS
#: Delimiter classes: (characters, tight or spaced, first guess of the split probability).
CLASSES = ("break", "bar", "semicolon", "bullet", "comma", "slash", "tight slash", "dash")
_FIRST_SPLIT = np.array([0.95, 0.95, 0.95, 0.95, 0.9, 0.6, 0.05, 0.2])
_TIGHT = CLASSES.index("tight slash")
#: Atoms that one value joins at most across delimiters that rather split; across those that rather do not, any number.
SPAN = 3
#: Base measure of one atom, as a negative log.
_BASE = 14.0

_BLOCK_TAG = re.compile(r"<\s*/?\s*(?:br|li|p|div|ul|ol|tr|td|th|table|h[1-6])\b[^>]*>", re.I)
_ANY_TAG = re.compile(r"<!--.*?-->|</?[a-z][^<>]*>", re.I | re.S)
_LABEL = re.compile(r"\s*[\"']?\s*(?:ingredients?|contents|composition)\s*(?::|-|–)\s*", re.I)
_BRACKETS = {"(": ")", "[": "]", "{": "}"}
_QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}


def plain(text: str) -> str:
    """Markup removed (block tags become line breaks), entities decoded, the leading label and final full stop dropped."""
    text = html.unescape(_ANY_TAG.sub("", _BLOCK_TAG.sub("\n", text)))
    text = text.strip()
    text = text[m.end() :] if (m := _LABEL.match(text)) else text
    return text[:-1] if text.endswith(".") else text


def _closing_quote(text: str, start: int, quote: str) -> int:
    """Index of the quote that ends a span opened at ``start``, or -1; doubled quotes stay inside."""
    i = start + 1
    while True:
        i = text.find(quote, i)
        if i < 0:
            return -1
        if text.startswith(quote, i + 1):
            i += 2
            continue
        if quote in "'’" and i + 1 < len(text) and text[i + 1].isalnum():  # an apostrophe
            i += 1
            continue
        return i


def _class_at(text: str, i: int) -> int:
    """Class of the delimiter at ``i``, or -1."""
    c = text[i]
    if c in "\n\r\t":
        return 0
    if c == "|":
        return 1
    if c == ";":
        return 2
    if c in "•·":
        return 3
    if c == ",":
        return -1 if 0 < i < len(text) - 1 and text[i - 1].isdigit() and text[i + 1].isdigit() else 4
    spaced = 0 < i < len(text) - 1 and text[i - 1].isspace() and text[i + 1].isspace()
    if c == "/":
        digits = 0 < i < len(text) - 1 and text[i - 1].isdigit() and text[i + 1].isdigit()
        return -1 if digits else 5 if spaced else 6
    return 7 if c in "-–" and spaced else -1


_SIGNS = re.compile(r"""[\n\r\t|;•·,/\-–()\[\]{}"'“‘]""")


def _closers(text: str) -> dict[int, int]:
    """Where each closed bracket ends. A bracket that is never closed is an ordinary character."""
    out: dict[int, int] = {}
    opened: list[int] = []
    for m in _BRACKET.finditer(text):
        if (c := m.group()) in _BRACKETS:
            opened.append(m.start())
        elif opened and _BRACKETS[text[opened[-1]]] == c:
            out[opened.pop()] = m.start()
    return out


_BRACKET = re.compile(r"[()\[\]{}]")


def lattice(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Atoms as (start, end), and the class of the delimiter after each atom but the last; empty atoms are skipped. Linear in the text."""
    atoms: list[tuple[int, int]] = []
    between: list[int] = []
    start, at, pending = 0, 0, -1
    closers = _closers(text) if _BRACKET.search(text) else {}

    def close(end: int) -> None:
        nonlocal pending
        if text[start:end].strip():
            if atoms:
                between.append(pending)
            atoms.append((start, end))
            pending = -1

    fresh = 0  # the atom has no text before here
    while m := _SIGNS.search(text, at):
        i, c = m.start(), m.group()
        at = i + 1
        if c in _QUOTES:
            if not text[fresh:i].strip() and (j := _closing_quote(text, i, _QUOTES[c])) >= 0:
                at = j + 1
        elif c in _BRACKETS:
            at = closers.get(i, i) + 1
        elif (k := _class_at(text, i)) >= 0:
            close(i)
            pending = k if pending < 0 else min(pending, k)
            start = fresh = i + 1
    close(len(text))
    return atoms, between


def value_text(raw: str) -> str:
    """The value as it is returned: quotes around it removed, doubled inner ones made single, white space collapsed."""
    raw = " ".join(raw.split())
    if raw and raw[0] in _QUOTES:
        q = _QUOTES[raw[0]]
        end = _closing_quote(raw, 0, q)
        if end > 0:
            raw = (raw[1:end].replace(q + q, q) + raw[end + 1 :]).strip()
    return " ".join(raw.split())


@functools.lru_cache(maxsize=200_000)
def _normal(value: str) -> str:
    """What counts as the same value when frequencies are learned: letter case, numbers, bracketed notes and punctuation do not matter."""
    return " ".join(_WORD.findall(_NOTE.sub("", value.lower())))


_NOTE, _WORD = re.compile(r"\([^()]*\)|\[[^\[\]]*\]|[\d.,%]+"), re.compile(r"[^\W_]+")


@functools.lru_cache(maxsize=500_000)
def _cells(name: str) -> tuple[int, ...]:
    h = int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return tuple(r * BUCKETS + (h >> 17 * r) % BUCKETS for r in range(ROWS))


class Model:
    """Log probabilities of values (in a sketch) and of a split at each delimiter class.

    A value's probability mixes its learned frequency, less the one occurrence that is being
    explained, with a base measure that gives any segmentation of the same atoms the same
    weight (words around a tight slash weigh as one atom). Values never seen elsewhere are
    therefore left to the delimiter classes.
    """

    def __init__(self, counts: np.ndarray, split: np.ndarray):
        self.counts, self.split = counts, split
        self.total = float(counts[:BUCKETS].sum())
        # What other values add to a cell on average is taken off, so that a full sketch does not make every value known.
        self.known = np.maximum(0.0, counts - (self.total - counts) / (BUCKETS - 1)).tolist()
        self.log_split, self.log_join = np.log(split).tolist(), np.log1p(-split).tolist()
        self.rather = (split >= 0.5).tolist()
        self.base = [math.exp(-_BASE * w) for w in range(40)]

    def arcs(self, text: str, atoms: list[tuple[int, int]], between: list[int]) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each end atom: (first atom, cells of the value, log score) of the values that end there."""
        out: list[list[tuple[int, tuple[int, ...], float]]] = []
        normal = [_normal(text[a:b]) for a, b in atoms]
        known, base, total = self.known, self.base, self.total
        for j in range(len(atoms)):
            row = []
            joined, name, width, hard = 0.0, normal[j], 1, False
            for i in range(j, -1, -1):
                if i < j:
                    k = between[i]
                    hard = hard or self.rather[k]
                    if hard and j - i >= SPAN:
                        break
                    joined += self.log_join[k]
                    width += k != _TIGHT
                    name = f"{normal[i]}{k}{name}"
                cells = _cells(name)
                p = base[width] if width < 40 else 1e-300
                if total:
                    x, y, z = cells
                    n = min(known[x], known[y], known[z]) - 1.0
                    if n > 0:
                        p += n / total
                row.append((i, cells, math.log(max(p, 1e-300)) + joined + (self.log_split[between[i - 1]] if i else 0.0)))
            out.append(row)
        return out

    def viterbi(self, text: str) -> list[str]:
        atoms, between = lattice(text)
        best, back = [0.0], []
        for row in self.arcs(text, atoms, between):
            score, i = max((best[i] + s, i) for i, _, s in row)
            best.append(score)
            back.append(i)
        out, j = [], len(atoms)
        while j:
            out.append(value_text(text[atoms[back[j - 1]][0] : atoms[j - 1][1]]))
            j = back[j - 1]
        return [v for v in reversed(out) if v]

    def expect(self, text: str, counts: dict[int, float], splits: np.ndarray) -> None:
        """Adds the text's expected value counts, and its expected splits and delimiters by class."""
        atoms, between = lattice(text)
        if not atoms:
            return
        arcs = self.arcs(text, atoms, between)
        n = len(atoms)
        fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
        for j, row in enumerate(arcs, 1):
            fwd[j] = _log_sum([fwd[i] + s for i, _, s in row])
        leaving: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for j, row in enumerate(arcs, 1):
            for i, _, s in row:
                leaving[i].append((j, s))
        for i in range(n - 1, -1, -1):
            bwd[i] = _log_sum([bwd[j] + s for j, s in leaving[i]])
        for j, row in enumerate(arcs, 1):
            for i, cells, s in row:
                p = math.exp(min(0.0, fwd[i] + s + bwd[j] - fwd[n]))
                for c in cells:
                    counts[c] = counts.get(c, 0.0) + p
                if i:
                    splits[0, between[i - 1]] += p
        for k in between:
            splits[1, k] += 1


def _log_sum(xs: list[float]) -> float:
    if len(xs) == 1:
        return xs[0]
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def learn(texts: DataFrame, column: str, rounds: int = 2) -> Model:
    """EM over every text of the column. The sums are exact over all rows; nothing is sampled.

    Repeated texts are counted once, since a copy is no evidence of another value.
    """
    ship(texts.sparkSession)
    sc = texts.sparkSession.sparkContext
    rows = texts.where(F.length(F.trim(column)) > 0).select(F.col(column).alias("text")).distinct()
    rows = rows.repartition(max(sc.defaultParallelism, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))  # few bytes, much work
    model = Model(np.zeros(_CELLS), _FIRST_SPLIT)
    for _ in range(rounds):
        shared = sc.broadcast((model.counts, model.split))

        def expected(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now = Model(*shared.value)
            counts: dict[int, float] = {}
            splits = np.zeros((2, len(CLASSES)))
            for batch in batches:
                for text in batch["text"]:
                    now.expect(plain(text), counts, splits)
            extra = [(_CELLS + r * len(CLASSES) + c, splits[r, c]) for r in range(2) for c in range(len(CLASSES))]
            yield pd.DataFrame([*counts.items(), *extra], columns=["cell", "n"])

        got = rows.mapInPandas(expected, "cell bigint, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        sums = np.zeros(_CELLS + 2 * len(CLASSES))
        sums[got["cell"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=float)
        counts, (split, seen) = sums[:_CELLS], sums[_CELLS:].reshape(2, -1)
        model = Model(counts, np.clip((split + _FIRST_SPLIT * 4) / (seen + 4), 1e-4, 1 - 1e-4))
    return model


def split_values(df: DataFrame, column: str, id_col: str, rounds: int = 2) -> DataFrame:
    """Rows ``(id, pos, value)``, ``pos`` from 1 over the non-empty values of each field.

    Null and blank fields give no row; a field of one value gives one row; repeated rows give
    repeated results; texts of any length are read whole; an empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    model = learn(df.select(F.col(column).alias("text")), "text", rounds)
    shared = df.sparkSession.sparkContext.broadcast((model.counts, model.split))

    def values(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        now = Model(*shared.value)
        for batch in batches:
            yield pd.Series([now.viterbi(plain(t)) if t else [] for t in batch])

    out = df.select(F.col(id_col).alias("_id"), F.pandas_udf(_typed(values), "array<string>")(F.col(column)).alias("_v"))
    return out.select(F.col("_id").alias(id_col), F.posexplode("_v").alias("_p", "value")).select(id_col, (F.col("_p") + 1).cast("int").alias("pos"), "value")


def _typed(fn):
    """The iterator form of a pandas UDF is read off annotations, which a closure's strings hide."""
    fn.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return fn
