"""Per-document text statistics, and telling prose from lists, tables and junk.

Texts are read once, into basic counts, layout measures, and counts of function words and
character classes. Summed over all documents by their likeliest language those counts, at most
one row per language and feature, are the prose profiles. A second pass over the counts alone
compares each document with its language's profile by Jensen-Shannon divergence and assigns the
nearest structural profile (prose, list, table or junk). A text in a script or language without
a profile is judged by the measures that do not depend on one.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ship

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_ENDING = tuple(".!?…。！？")
#: Character classes: letters a-z by themselves, then these.
CLASSES = [*"abcdefghijklmnopqrstuvwxyz", "other letter", "digit", "stop", "symbol", "space", "broken"]
_CLASS_AT = {c: i for i, c in enumerate(CLASSES)}
_PLAIN_MARKS = set(".,;:!?'\"’‘“”()-–")
_ACCENTS = {"à": "a", "á": "a", "â": "a", "ä": "a", "ã": "a", "å": "a", "ç": "c", "è": "e", "é": "e", "ê": "e", "ë": "e", "ì": "i", "í": "i", "î": "i", "ï": "i", "ñ": "n", "ò": "o", "ó": "o", "ô": "o", "ö": "o", "õ": "o", "ù": "u", "ú": "u", "û": "u", "ü": "u", "ß": "s"}
_BROKEN = set("�¢§©¬¦¤¶±×Ã\x80\x81\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8d\x8e\x8f\x90\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9d\x9e\x9f")


@functools.cache
def _tables() -> dict[str, np.ndarray]:
    """By code point: its class, and whether it is a mark (1) or a mark of code (2); filled as code points are met."""
    return {"class": np.full(0x110000, 255, np.uint8), "mark": np.zeros(0x110000, np.uint8)}


def _classify(c: str) -> tuple[int, int]:
    low = _ACCENTS.get(c.lower(), c.lower())
    if low in _CLASS_AT and len(low) == 1:
        k = _CLASS_AT[low]
    elif low in _BROKEN:
        k = _CLASS_AT["broken"]
    elif low.isalpha():
        k = _CLASS_AT["other letter"]
    elif low.isdigit():
        k = _CLASS_AT["digit"]
    elif low.isspace():
        k = _CLASS_AT["space"]
    else:
        k = _CLASS_AT["stop" if low in _PLAIN_MARKS else "symbol"]
    return k, 0 if c.isalnum() or c.isspace() else 2 if c in _CODE else 1


def char_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text its counts by class, its marks and its marks of code."""
    n = len(texts)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(n), np.fromiter((len(t) for t in texts), np.int64, n))
    tables = _tables()
    met = np.zeros(0x110000, bool)
    met[codes] = True
    for cp in np.flatnonzero(met & (tables["class"] == 255)).tolist():
        tables["class"][cp], tables["mark"][cp] = _classify(chr(cp))
    mark = tables["mark"][codes]
    counts = np.bincount(row * len(CLASSES) + tables["class"][codes], minlength=n * len(CLASSES)).reshape(n, -1).astype(float)
    return counts, np.bincount(row, mark > 0, n), np.bincount(row, mark == 2, n)


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of each row of ``p`` and the row of ``q`` (or ``q``), between 0 and 1; 1 if either is empty."""
    q = np.broadcast_to(q, p.shape)
    sums = p.sum(1), q.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        p, q = p / sums[0][:, None], q / sums[1][:, None]
        m = (p + q) / 2
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0.0).sum(1)
        out = np.maximum(0.0, 0.5 * kl(p) + 0.5 * kl(q))
    return np.where((sums[0] > 0) & (sums[1] > 0), out, 1.0)


_READABLE = re.compile(r"[^\W\d_]?[^\W\dA-Z_]*(?:['’][^\W\d_]+)?|[^\W\da-z_]+(?:['’][^\W\d_]+)?")
_CODE = set("{}[]<>=^~\\+$@#_`|&")
_NO_VOWEL_RUN, _VOWEL = re.compile("[^aeiouyà-ÿ'’]{5}"), re.compile("[aeiouyà-ÿ]")
_NUMERIC, _TWO_SPACES = re.compile(r"[£$€]?\s*[-+]?\d[\d.,]*\s*%?|:?-{2,}:?"), re.compile(r"\s{2,}")
_PIECE = re.compile(r"[,;|•·\t\n\r、。，；！？]|(?<=\w)\.(?=\s)|[!?]")
_WIDE = re.compile("[\u2e80-\uffff]")


@functools.lru_cache(maxsize=200_000)
def _is_readable(w: str) -> bool:
    """Whether a word can be pronounced in a language of Latin letters."""
    low = w.lower()
    return bool(_READABLE.fullmatch(w)) and len(w) <= 22 and (len(w) < 4 or bool(_VOWEL.search(low))) and not _NO_VOWEL_RUN.search(low)


def _units(piece: str) -> float:
    """Words of a piece; two letters of a script without blanks count as one."""
    return len(piece.split()) + (0 if piece.isascii() else len(_WIDE.findall(piece)) / 2)


class Words:
    """Function words by language, as the table of common words gives them."""

    def __init__(self, rows: list[tuple[str, str]]):
        self.langs = sorted({lang for lang, _ in rows})
        self.of = {lang: {w.lower(): k for k, w in enumerate(sorted({w for g, w in rows if g == lang}))} for lang in self.langs}
        self.width = max((len(v) for v in self.of.values()), default=0) + 1

    def counts(self, words: Counter) -> tuple[int, np.ndarray, int]:
        """Likeliest language (by hits), its function-word counts with all other words last, and the hits."""
        most, best, found = -1, 0, []
        for k, lang in enumerate(self.langs):
            at = self.of[lang]
            own = [(at[w], words[w]) for w in at.keys() & words.keys()]
            hits = sum(n for _, n in own)
            if hits > most:
                most, best, found = hits, k, own
        v = np.zeros(self.width)
        for i, n in found:
            v[i] = n
        v[-1] = words.total() - max(0, most)
        return best, v, max(0, most)


def _fields(lines: list[str]) -> tuple[float, int, float]:
    """Share of lines with the commonest number of fields, that number, and the share of numeric cells in them."""
    best = (0.0, 1, 0.0)
    for mark in ("|", "\t", ";", ",", "  "):
        if sum(mark in ln for ln in lines) < 2:
            continue
        split = [[c.strip().strip("\"'") for c in (_TWO_SPACES.split(ln.strip()) if mark == "  " else (ln.strip().strip("|") if mark == "|" else ln).split(mark))] for ln in lines]
        widths = Counter(len(s) for s in split if len(s) > 2)
        if not widths:
            continue
        if mark in ",;" and len(widths) > 0.5 * len(lines) + 2:
            continue
        width, n = max(widths.items(), key=lambda x: (x[1], x[0]))
        if n < 2:
            continue
        n += widths[width - 1]  # a last cell may be missing
        cells = [c for s in split if len(s) == width for c in s]
        numeric = sum(bool(_NUMERIC.fullmatch(c)) for c in cells) / len(cells)
        got = (n / len(lines), width, numeric)
        if got[0] * (0.3 + numeric) > best[0] * (0.3 + best[2]):
            best = got
    return best


_MEASURES = ("n_words", "mean_word_length", "line_end_share", "entropy", "readable", "lettered", "single", "row_share", "row_width", "numeric", "n_lines", "short_pieces", "repeats")


def measures(text: str, raw: Counter, words: Counter) -> tuple[float, ...]:
    """Layout and readability measures of one text, as ``_MEASURES`` names them."""
    lines = [ln for ln in text.splitlines() if ln.strip()]
    n = words.total()
    lengths = sum(len(w) * c for w, c in words.items())
    entropy = -sum(c / n * math.log2(c / n) for c in words.values()) if n else 0.0
    readable = lettered = 0
    for w, c in raw.items():
        if not w.isdigit():
            lettered += c
            if _is_readable(w):
                readable += c
    single = sum(c for w, c in words.items() if len(w) == 1 and w.isalpha())
    repeats = sum(c for w, c in words.items() if c > 1 and len(w) <= 4 and w.isalpha())
    share, width, numeric = _fields(lines) if len(lines) > 1 else (0.0, 1, 0.0)
    pieces = [p for p in _PIECE.split(text) if p.strip()]
    short = sum(_units(p) <= 6 for p in pieces)
    ended = sum(ln.rstrip().endswith(_ENDING) for ln in lines)
    return (
        n, lengths / n if n else 0.0, ended / len(lines) if lines else 0.0, entropy, readable / lettered if lettered else 0.0, lettered / n if n else 0.0,
        single / n if n else 0.0, share, width, numeric, len(lines), short / len(pieces) if pieces else 0.0, repeats / n if n else 0.0,
    )


# Structural profiles: what is measured of a typical text of each kind, and the scale of each measure.
_AXES = ("common_share", "function_jsd", "table", "short_pieces", "noise")
_SCALE = np.array([0.22, 0.22, 0.5, 0.9, 0.35])
_PROFILES = {
    "prose": np.array([0.40, 0.04, 0.0, 0.2, 0.0]),
    "list": np.array([0.02, 0.23, 0.0, 1.0, 0.0]),
    "table": np.array([0.01, 0.23, 1.0, 1.0, 0.0]),
    "junk": np.array([0.02, 0.23, 0.0, 0.6, 1.0]),
}


#: Axes that need a profile of the language.
_OF_LANGUAGE = np.array([True, True, False, False, False])


def kinds_of(m: dict[str, np.ndarray], common_share: np.ndarray, function_jsd: np.ndarray, letter_jsd: np.ndarray, chars: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Nearest structural profile of each document."""
    total = np.maximum(1.0, chars.sum(1))
    broken = chars[:, _CLASS_AT["broken"]] / total
    latin, other = chars[:, :26].sum(1), chars[:, _CLASS_AT["other letter"]]
    table = np.where((m["row_width"] >= 3) & (m["n_lines"] >= 2), m["row_share"] * np.minimum(1.0, 0.35 + 2.5 * m["numeric"]), 0.0)
    rows = table >= 0.6
    n = m["n_words"]
    ramp = lambda x: np.clip(x, 0.0, 1.0)
    # How unreadable a text is, from 0 to 1: the strongest of its signs, first those of any language.
    noise = np.maximum.reduce([
        np.where((n >= 8) & (m["entropy"] < np.minimum(2.6, 0.55 * np.log2(np.maximum(n, 1)))), 1.0, 0.0), ramp(broken * 12), np.where(rows, 0.0, ramp((code - 0.03) * 12)),
        np.where((n == 0) | (m["lettered"] < 0.15), 1.0, 0.0),
    ])
    of_latin = np.maximum.reduce([
        np.where(m["lettered"] > 0, ramp((0.92 - m["readable"]) / 0.35), 0.0), np.where((latin + other >= 120) & ~rows, ramp((letter_jsd - 0.11) * 20), 0.0),
        np.where(m["mean_word_length"] > 20, 1.0, 0.0), ramp((m["single"] - 0.4) * 4),
    ])
    script = other > latin  # another script than the profiles'
    # Another language of Latin letters: pronounceable words in running text, short words that come again.
    tongue = ~script & (common_share < 0.36) & (n >= 8) & (m["readable"] >= 0.85) & (m["short_pieces"] < 0.6) & (letter_jsd < 0.3) & (m["single"] < 0.4) & (m["mean_word_length"] <= 20) & ((m["repeats"] >= 0.1) | (n < 25)) & (noise < 0.5)
    noise = np.where(script, np.maximum(noise, np.where((m["single"] > 0.8) & (n >= 8), 1.0, 0.0)), np.where(tongue, noise, np.maximum(noise, of_latin)))
    x = np.stack([common_share, np.minimum(0.3, function_jsd), table, m["short_pieces"], noise], axis=1)
    used = np.where((script | tongue)[:, None] & _OF_LANGUAGE, 0.0, 1.0)
    far = np.stack([((((x - centre) / _SCALE) ** 2) * used).sum(1) for centre in _PROFILES.values()], axis=1)
    return np.array(list(_PROFILES))[far.argmin(1)]


#: Rows of the table of common words that are broadcast.
WORDS = 100_000
STATS = "n_words bigint, mean_word_length double, symbol_ratio double, line_end_share double, common_share double, function_jsd double, char_jsd double, kind string"


def document_statistics(df: DataFrame, common: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``(id, n_words, mean_word_length, symbol_ratio, line_end_share, common_share, function_jsd, char_jsd, kind)``.

    One row per input row. A null or blank text has zeros, divergences of 1 and a null kind. The
    texts are read whole and once; their counts (some 80 numbers a text) are kept, and only profile
    sums move: a row per language and feature. The table of common words must be small (at
    most ``WORDS`` rows, the bound of what is broadcast; it holds some dozens for each language).
    """
    ship(df.sparkSession)
    listed = [(r["lang"], r["word"]) for r in common.select("lang", "word").where("lang is not null and word is not null").distinct().limit(WORDS + 1).collect()]
    if len(listed) > WORDS:
        raise ValueError(f"more than {WORDS} common words")
    kind = df.select(id_col).schema[0].dataType
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))  # as a string an id survives nulls beside it exactly
    words = Words(listed)
    width, n_langs = words.width, max(1, len(words.langs))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Words(listed)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            chars, marks, code = char_counts(texts)
            out = []
            for t in texts:
                raw = Counter(_WORD.findall(t))
                low: Counter = Counter()
                for w, n in raw.items():
                    low[w.lower()] += n
                k, v, hits = known.counts(low)
                out.append((*measures(t, raw, low), k, hits, v.astype(np.float32)))
            got = pd.DataFrame(out, columns=[*_MEASURES, "lang", "hits", "function"])
            yield got.assign(id=batch["id"], blank=[not t.strip() for t in texts], marks=marks, code=code, chars=list(chars.astype(np.float32)))

    schema = "id string, " + ", ".join(f"{c} double" for c in _MEASURES) + ", lang int, hits double, function array<float>, blank boolean, marks double, code double, chars array<float>"
    counts = checkpointed(rows.mapInPandas(counted, schema))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        function, chars = np.zeros((n_langs, width)), np.zeros((n_langs, len(CLASSES)))
        for batch in batches:
            if len(batch):
                np.add.at(function, batch["lang"], np.stack(batch["function"]))
                np.add.at(chars, batch["lang"], np.stack(batch["chars"]))
        yield pd.DataFrame({"f": range(function.size + chars.size), "n": np.concatenate((function.ravel(), chars.ravel()))})

    flat = np.zeros(n_langs * (width + len(CLASSES)))
    prose = counts.where("hits > 0 and hits >= 0.15 * n_words").select("lang", "function", "chars")
    for r in prose.mapInPandas(sums, "f int, n double").groupBy("f").agg(F.sum("n").alias("n")).collect():  # one row per feature
        flat[r["f"]] = r["n"]
    function = flat[: n_langs * width].reshape(n_langs, width)
    profiles = flat[n_langs * width :].reshape(n_langs, len(CLASSES))
    if not profiles.sum():
        profiles = np.ones_like(profiles)
    profiles = profiles[profiles.sum(1) > 0]

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            chars, own = np.stack(b["chars"]).astype(float), np.stack(b["function"]).astype(float)
            n, blank = b["n_words"].to_numpy(), b["blank"].to_numpy()
            share = np.where(n > 0, b["hits"] / np.maximum(1, n), 0.0)
            solid = chars.sum(1) - chars[:, _CLASS_AT["space"]]
            solid = np.where(solid > 0, solid, 1.0)
            fj = divergences(own, function[b["lang"].to_numpy()])
            lj = np.minimum.reduce([divergences(chars[:, :26], p[:26]) for p in profiles])
            cj = np.minimum.reduce([divergences(chars, p) for p in profiles])
            kinds = kinds_of({c: b[c].to_numpy() for c in _MEASURES}, share, fj, lj, chars, b["code"].to_numpy() / solid)
            zero = lambda x: np.where(blank, 0.0, x)
            yield pd.DataFrame({
                "id": b["id"], "n_words": zero(n).astype(np.int64), "mean_word_length": zero(b["mean_word_length"]), "symbol_ratio": zero(b["marks"] / solid), "line_end_share": zero(b["line_end_share"]),
                "common_share": zero(share), "function_jsd": np.where(blank, 1.0, fj), "char_jsd": np.where(blank, 1.0, cj), "kind": np.where(blank, None, kinds),
            })

    return counts.mapInPandas(judged, f"id string, {STATS}").select(F.col("id").cast(kind).alias(id_col), *(x.split()[0] for x in STATS.split(", ")))
