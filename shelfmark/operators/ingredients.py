"""Ingredient texts to ingredient tokens.

A text splits at commas and blanks outside brackets; pieces with a digit are percentages and
vanish; a bracketed piece keeps its inner words and splits at its commas. Words outside
brackets therefore come out one by one, which is what the golden records hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGIT = re.compile(r"\d")


def pieces(text: str, separators: str) -> Iterator[str]:
    """Stretches between separators that lie outside round brackets, trimmed, empty ones dropped."""
    depth = start = 0
    for at, c in enumerate(text):
        if c == "(":
            depth += 1
        elif c == ")":
            depth = max(0, depth - 1)
        elif not depth and c in separators:
            if piece := text[start:at].strip():
                yield piece
            start = at + 1
    if piece := text[start:].strip():
        yield piece


def tokens(text: str | None) -> list[str]:
    out: list[str] = []
    for piece in pieces(text or "", ", "):
        if not _DIGIT.search(piece) and (bare := piece.strip(" ()[]")):
            out.extend(pieces(bare, ",") if "," in bare else [bare])
    return out


def split(c: Column) -> Column:
    """Array of ingredient tokens; empty for null (one Arrow batch to Python and back)."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(tokens)

    return F.pandas_udf(run, "array<string>")(c)
