"""Markup residue: HTML, Markdown, wiki and LaTeX to clean text that keeps its structure.

A text is read as a sequence of leaves: stretches of text with the path of tags, line
markers and environments around them. A bidirectional LSTM in numpy reads the whole
sequence, each leaf as hashed path and word vectors, and labels every leaf (plain, marked
text, heading, list, code, formula). Marks such as ``#``, ``*`` or ``$`` mean different
things in different documents, so the label depends on the leaves before and after. An
exact check then drops a label whose leaf holds no mark that could set it.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

LABELS = ("plain", "text", "heading", "list", "code", "formula")
PATH_BINS, WORD_BINS, SHAPES = 96, 48, 12
MODEL = Path(__file__).with_name("markup_model.npz")

_KNOWN_TAGS = set(
    "a abbr article aside b big blockquote body br button caption center cite code col dd del details div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark math meta mfrac mi mn mo mrow msup msub nav nowiki ol p pre q ref s samp script section small source span strike strong style sub summary sup syntaxhighlight table tbody td tfoot th thead title tr tt u ul var video".split()
)
_BLOCK_TAGS = set("article aside blockquote body br caption center dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main math nav ol p pre section syntaxhighlight table td th tr ul".split())
_VOID_TAGS = {"br", "hr", "img", "input", "meta", "link", "source", "col"}
_TAG = re.compile(r"<!--.*?(?:-->|$)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<attrs>(?:\s[^<>]*|\s*/\s*)?)>|<(?P<broken>/?[a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?/?\s*(?=$|<)", re.S)
_ESCAPED = re.compile(r"&lt;\s*/?\s*[a-zA-Z!][^&<>]*?(?:&quot;[^&<>]*?)*/?\s*&gt;|&amp;(?:[a-zA-Z]{2,8}|#\d+);")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});")
_MATH = re.compile(r"\\\[(?P<d>.+?)\\\]|\\\((?P<p>.+?)\\\)|\$\$(?P<dd>.+?)\$\$|\$(?P<s>[^$\n]+?)\$|\\begin\{(?P<env>equation\*?|align\*?|displaymath|math)\}(?P<e>.*?)\\end\{(?P=env)\}", re.S)
_VERBATIM = re.compile(r"\\begin\{(?P<env>verbatim|lstlisting|minted)\}(?:\{[^}]*\}|\[[^\]]*\])?(?P<body>.*?)(?:\\end\{(?P=env)\}|$)", re.S)
_FENCE = re.compile(r"^[ \t]{0,3}(?P<f>```+|~~~+)[^\n`]*\n(?P<body>.*?)(?:^[ \t]{0,3}(?P=f)[ \t]*$|\Z)", re.S | re.M)
_TICKS = re.compile(r"`(?P<c>[^`\n]+)`")
_LINE = [
    ("wiki:==", re.compile(r"^\s*(={1,6})(?!=)\s*(.+?)\s*\1\s*$")),
    ("md:##", re.compile(r"^ {0,3}#{2,6}\s+(.+?)\s*#*\s*$")),
    ("md:# #", re.compile(r"^ {0,3}#\s+(.+?)\s+#\s*$")),
    ("line:#", re.compile(r"^ {0,3}#\s+(.+?)\s*$")),
    ("line:#.", re.compile(r"^ {0,3}#(?:[#*:]+|(?=\[\[))\s*(.+?)\s*$")),
    ("tex:section", re.compile(r"^\s*\\(?:sub)*(?:section|paragraph|chapter)\*?\{(.+?)\}\s*$")),
    ("tex:item", re.compile(r"^\s*\\item\b\s*(.*?)\s*$")),
    ("line:*", re.compile(r"^\s*\*{1,3}\s+(.+?)\s*$")),
    ("line:*.", re.compile(r"^\s*\*{1,3}(?=\[\[)(.+?)\s*$")),
    ("line:-", re.compile(r"^\s*[-+]\s+(.+?)\s*$")),
    ("line:1.", re.compile(r"^\s*\d{1,3}[.)]\s+(.+?)\s*$")),
    ("line:=====", re.compile(r"^\s*(={3,})\s*$")),
    ("line:-----", re.compile(r"^\s*(-{3,})\s*$")),
    ("tex:begin", re.compile(r"^\s*\\(?:begin|end)\{([a-z*]+)\}.*$")),
    ("wiki:{{", re.compile(r"^\s*\{\{(.+)$")),
    ("wiki:|", re.compile(r"^\s*\|\s*(\w[\w ]*=.*)$")),
    ("wiki:}}", re.compile(r"^\s*\}\}(.*)$")),
]
_INLINE = [
    ("md:**", re.compile(r"(?<![\w*])\*\*(?=\S)[^*\n]+?(?<=\S)\*\*(?!\*)|(?<!\w)__(?=\S)[^_\n]+?(?<=\S)__(?!\w)")),
    ("md:_", re.compile(r"(?<![\w_])_(?=[^\s_])[^_\n]*?(?<=[^\s_])_(?![\w_])|(?<![\w*])\*(?=[^\s*])[^*\n]*?(?<=[^\s*])\*(?![\w*])")),
    ("md:link", re.compile(r"!?\[[^\]\n]*\]\([^)\s]+\)")),
    ("wiki:''", re.compile(r"'{2,5}(?=[^'\s]).+?(?<=[^'])'{2,5}")),
    ("wiki:[[", re.compile(r"\[\[[^\]\n]+\]\]")),
    ("wiki:{{", re.compile(r"\{\{[^{}]+\}\}")),
    ("tex:cmd", re.compile(r"\\(?:textbf|textit|emph|texttt|underline|textsc|href|url|footnote|cite|ref|label|mbox)\s*\{|\{\s*\\(?:bf|it|em|tt|sc|rm|sl)\b")),
]


class Leaf(NamedTuple):
    text: str
    path: tuple[str, ...]
    mark: str = ""  # what is written before it if it is a heading or an item, with its level or number
    row: int = 0  # number of the table row it is a cell of


def _lines(text: str, path: tuple[str, ...], out: list[Leaf]) -> None:
    """Leaves of one stretch of text between tags: verbatim and math first, then line by line."""
    at = 0
    for m in sorted([*_FENCE.finditer(text), *_VERBATIM.finditer(text)], key=lambda m: m.start()):
        if m.start() < at:
            continue
        _math(text[at : m.start()], path, out)
        out.append(Leaf(m["body"].strip("\n"), (*path, "code:fence" if m.re is _FENCE else "code:verbatim")))
        at = m.end()
    _math(text[at:], path, out)


def _math(text: str, path: tuple[str, ...], out: list[Leaf]) -> None:
    at = 0
    for m in _MATH.finditer(text):
        if m["s"] is not None and (m.end() < len(text) and text[m.end()].isdigit() or m["s"][0].isspace() or m["s"][-1].isspace()):
            kind, body = "math:price", m["s"]  # spaced or run on to digits, as prices are
        elif m["s"] is not None:
            kind, body = "math:$", m["s"]
        else:
            kind, body = "math:block", m["d"] or m["p"] or m["dd"] or m["e"] or ""
        if kind == "math:price":
            continue
        _plain_lines(text[at : m.start()], path, out)
        out.append(Leaf(body.strip(), (*path, kind)))
        at = m.end()
    _plain_lines(text[at:], path, out)


def _line_mark(name: str, line: str) -> str:
    """What stands before a heading or an item in clean text, by the mark of its line."""
    bare = line.strip()
    indent = "  " * ((len(line) - len(line.lstrip())) // 2)
    if name == "wiki:==":
        return "#" * (len(bare) - len(bare.lstrip("="))) + " "
    if name in ("md:##", "md:# #", "line:#"):
        return "#" * (len(bare) - len(bare.lstrip("#"))) + " "
    if name == "tex:section":
        return "#" * (1 + bare.count("sub", 0, bare.index("{")) + (3 if "paragraph" in bare[: bare.index("{")] else 0)) + " "
    if name in ("line:*", "line:*.", "line:#."):
        signs = re.match(r"[*#:]+", bare).group()
        return indent + "  " * (len(signs) - 1) + ("1. " if signs[-1] == "#" else "- ")
    if name == "line:1.":
        return f"{indent}{re.match(r'[0-9]+', bare).group()}. "
    return indent + "- " if name in ("line:-", "tex:item") else ""


def _plain_lines(text: str, path: tuple[str, ...], out: list[Leaf]) -> None:
    for line in text.split("\n"):
        if not line.strip():
            continue
        own = list(path)
        body, mark = line.strip(), ""
        for name, pattern in _LINE:
            if m := pattern.match(line):
                own.append(name)
                mark = _line_mark(name, line)
                body = m.group(m.lastindex) if m.lastindex else ""
                break
        for name, pattern in _INLINE:
            if pattern.search(line):
                own.append(name)
        if _ENTITY.search(line) and html.unescape(line) != line:
            own.append("entity")
        for k, part in enumerate(_TICKS.split(body)):
            if part.strip():
                out.append(Leaf(part, (*own, "code:`") if k % 2 else tuple(own), mark))
                mark = ""


def leaves(text: str) -> list[Leaf]:
    """The text's leaves in order. Text without any mark gives leaves with empty paths."""
    base: tuple[str, ...] = ()
    if _ESCAPED.search(text):
        text, base = html.unescape(text), ("escaped",)
    out: list[Leaf] = []
    path: list[str] = []
    buffer: list[str] = []
    inline: list[str] = []
    lists: list[list] = []  # open lists as [ordered, items so far, whether the item has no text yet]
    row = 0

    def flush() -> None:
        first = len(out)
        collect()
        heading = next((t for t in reversed(path) if t[0] == "h" and t[1:].isdigit()), None)
        cell = any(t in ("td", "th") for t in path)
        for k in range(first, len(out)):
            mark = out[k].mark
            if heading:
                mark = "#" * int(heading[1:]) + " "
            elif lists and not mark:
                ordered, n, fresh = lists[-1]
                mark = "  " * (len(lists) - 1) + ((f"{n}. " if ordered else "- ") if fresh else "  ")
                lists[-1][2] = False
            out[k] = out[k]._replace(mark=mark, row=row if cell else 0)

    def collect() -> None:
        joined = "".join(buffer)
        buffer.clear()
        marks = (*base, *(f"html:{t}" for t in path), *sorted(set(inline)))
        inline.clear()
        if not joined.strip():
            if "html:broken" in marks or "html:comment" in marks or "html:br" in marks:
                out.append(Leaf("", marks))
            return
        if any(t in ("pre", "code", "syntaxhighlight", "samp", "kbd") for t in path):
            out.append(Leaf(joined.strip("\n"), marks))
        elif any(t == "math" for t in path):
            out.append(Leaf(joined.strip(), marks))
        else:
            _lines(joined, marks, out)

    at = 0
    silent = ""
    for m in _TAG.finditer(text):
        tag = (m["tag"] or (m["broken"] or "").lstrip("/")).lower()
        if tag and tag not in _KNOWN_TAGS:
            continue
        if silent:
            if m["close"] and tag == silent:
                silent, at = "", m.end()
            continue
        buffer.append(text[at : m.start()])
        at = m.end()
        if not tag:
            inline.append("html:comment")
            continue
        if m["broken"] is not None:
            inline.append("html:broken")
            continue
        if tag in ("script", "style") and not m["close"]:
            inline.append("html:comment")
            silent = tag
            continue
        if tag in _BLOCK_TAGS or tag == "code":
            if tag in _VOID_TAGS or tag == "br":
                inline.append("html:br")
            flush()
            if tag in _VOID_TAGS:
                inline.append("html:br")
                continue
            if m["close"]:
                if tag in ("ul", "ol") and lists:
                    lists.pop()
                if tag in path:
                    while path.pop() != tag:
                        pass
                else:
                    inline.append("html:broken")
            else:
                if tag in ("li", "p", "td", "th", "tr", "dd", "dt") and tag in path and not (tag == "li" and any(t in ("ul", "ol") for t in path[len(path) - path[::-1].index("li") :])):
                    while path.pop() != tag:
                        pass
                path.append(tag)
                if tag in ("ul", "ol"):
                    lists.append([tag == "ol", 0, True])
                elif tag == "li" and lists:
                    lists[-1][1:] = [lists[-1][1] + 1, True]
                elif tag == "tr":
                    row += 1
            continue
        inline.append("html:inline")
    if not silent:
        buffer.append(text[at:])
    flush()
    return out


_WORDS = re.compile(r"[^\W_]+|[^\w\s]")


@functools.lru_cache(maxsize=200_000)
def _bin(word: str) -> int:
    return zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORD_BINS


def features(seq: list[Leaf]) -> np.ndarray:
    """One row per leaf: hashed path elements, hashed words, and a few shapes."""
    x = np.zeros((len(seq), PATH_BINS + WORD_BINS + SHAPES), np.float32)
    for i, leaf in enumerate(seq):
        for p in leaf.path:
            x[i, zlib.crc32(p.encode()) % PATH_BINS] = 1.0
        words = _WORDS.findall(leaf.text)
        for w in words:
            x[i, PATH_BINS + _bin(w)] += 1.0 / len(words)
        t, k = leaf.text, PATH_BINS + WORD_BINS
        n = max(1, len(t))
        x[i, k : k + SHAPES] = (
            min(1.0, len(words) / 20), float(len(words) <= 6), sum(c.isalpha() for c in t) / n, sum(c.isdigit() for c in t) / n, sum(c in "=+^_\\{}<>*/" for c in t) / n, float(t[:1].isupper()),
            float(t.rstrip().endswith((".", "!", "?"))), float("\\" in t), float("^" in t or "\\frac" in t or "\\sum" in t), float("=" in t), float(not leaf.path), 1.0,
        )
    return x


class Labeller:
    """Forward pass of the bidirectional LSTM, for a batch of sequences."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.hidden = weights["fu"].shape[0]

    @classmethod
    def load(cls) -> dict[str, np.ndarray]:
        with np.load(MODEL) as f:
            return {k: f[k].astype(np.float32) for k in f.files}

    def run(self, x: np.ndarray, mask: np.ndarray, way: str) -> np.ndarray:
        """Hidden states over time; x is (time, batch, features), mask (time, batch, 1)."""
        h = np.zeros((x.shape[1], self.hidden), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((x.shape[0], x.shape[1], self.hidden), np.float32)
        n = self.hidden
        pre = x @ self.w[way + "w"] + self.w[way + "b"]
        steps = range(x.shape[0]) if way == "f" else range(x.shape[0] - 1, -1, -1)
        for t in steps:
            z = pre[t] + h @ self.w[way + "u"]
            gates = 1.0 / (1.0 + np.exp(-z[:, : 3 * n]))
            new_c = gates[:, n : 2 * n] * c + gates[:, :n] * np.tanh(z[:, 3 * n :])
            new_h = gates[:, 2 * n :] * np.tanh(new_c)
            c = np.where(mask[t], new_c, c)
            h = np.where(mask[t], new_h, h)
            out[t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate((self.run(x, mask, "f"), self.run(x, mask, "r")), axis=2)
        return both @ self.w["ow"] + x @ self.w["xw"] + self.w["ob"]

    def label(self, sequences: list[list[Leaf]], batch: int = 128) -> list[list[int]]:
        """Labels of every leaf; sequences of like length run together."""
        out: list[list[int]] = [[] for _ in sequences]
        order = sorted((i for i, s in enumerate(sequences) if s), key=lambda i: len(sequences[i]))
        k = 0
        while k < len(order):
            longest = len(sequences[order[min(len(order), k + batch) - 1]])
            some = order[k : k + (batch if longest <= 200 else max(1, batch * 200 // longest))]
            k += len(some)
            longest = max(len(sequences[i]) for i in some)
            x = np.zeros((longest, len(some), PATH_BINS + WORD_BINS + SHAPES), np.float32)
            mask = np.zeros((longest, len(some), 1), bool)
            for j, i in enumerate(some):
                f = features(sequences[i])
                x[: len(f), j], mask[: len(f), j] = f, True
            best = self.scores(x, mask).argmax(axis=2)
            for j, i in enumerate(some):
                out[i] = best[: len(sequences[i]), j].tolist()
        return out


#: Exact check: marks one of which a leaf of each label must hold.
_EVIDENCE = {
    2: re.compile(r"html:h[1-6]|wiki:==|md:##|md:# #|line:#$|tex:section|line:=====|line:-----"),
    3: re.compile(r"html:(?:li|ul|ol|dl|dt|dd)|line:[*\-#1]|tex:item"),
    4: re.compile(r"code:|html:(?:pre|code|syntaxhighlight|samp|kbd)"),
    5: re.compile(r"math:|html:math"),
}


def checked(leaf: Leaf, label: int) -> int:
    """The label, unless no mark of the leaf could set it: then marked text, or plain without any mark."""
    if label >= 2 and not any(_EVIDENCE[label].match(p) for p in leaf.path):
        label = 1
    if label and not leaf.path:
        label = 0
    return label


def _inner(text: str) -> str:
    """Inline marks removed, entities decoded."""
    text = re.sub(r"!?\[([^\]\n]*)\]\([^)\s]+\)", r"\1", text)
    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]|]*)\]\]", r"\1", text)
    text = re.sub(r"\{\{[^{}]*\}\}", "", text)
    text = re.sub(r"\\(?:textbf|textit|emph|texttt|underline|textsc|mbox)\s*\{([^{}]*)\}", r"\1", text)
    text = re.sub(r"\{\s*\\(?:bf|it|em|tt|sc|rm|sl)\b\s*([^{}]*)\}", r"\1", text)
    text = re.sub(r"\*\*(?=\S)([^*\n]+?)\*\*|(?<!\w)__(?=\S)([^_\n]+?)__(?!\w)", lambda m: m.group(1) or m.group(2), text)
    text = re.sub(r"(?<![\w_])_(?=[^\s_])([^_\n]*?)(?<=[^\s_])_(?![\w_])", r"\1", text)
    text = re.sub(r"'{2,5}(?=[^'\s])(.+?)(?<=[^'])'{2,5}", r"\1", text)
    return html.unescape(text).replace(" ", " ").strip()


def rendered(text: str, seq: list[Leaf], labels: list[int]) -> str:
    """Clean text: headings as ``## x`` by level, items as ``- x`` or ``2. x`` set in by depth, cells of a row with bars, code between fences, formulas between dollars; unmarked text as it is."""
    if not any(labels):
        return text
    out: list[str] = []
    last = 0
    for leaf, label in zip(seq, labels):
        if leaf.row and leaf.row == last and out and label not in (4, 5):
            if t := _inner(leaf.text):
                out[-1] += f" | {t}"
            continue
        last = leaf.row
        if label == 4:
            out.append(f"```\n{html.unescape(leaf.text)}\n```" if "\n" in leaf.text or "code:`" not in leaf.path else f"`{leaf.text}`")
        elif label == 5:
            out.append(f"${html.unescape(leaf.text)}$")
        elif any(p in ("wiki:{{", "wiki:|", "wiki:}}", "tex:begin", "line:=====", "line:-----") for p in leaf.path) and label < 2 or not (t := _inner(leaf.text)) or leaf.path[-1:] in (("line:=====",), ("line:-----",)):
            continue
        else:
            is_heading = leaf.mark.startswith("#")
            out.append((leaf.mark if is_heading else "# ") + t if label == 2 else (leaf.mark if leaf.mark and not is_heading else "- ") + t if label == 3 else t)
    return "\n".join(out)


def labelled(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """Rows ``(id, field, kinds, clean)`` for every field that is not null.

    ``kinds`` holds 'markup' if the field has any, and each of heading, list, code and formula
    that it sets; ``clean`` is the clean text (the text itself if it has no markup). A null field
    gives no row, an empty text gives no kinds; repeated rows give repeated results; texts of
    any length are read whole. Narrow: one pass, no shuffle; the model (about 150 kB) is broadcast.
    """
    spark = df.sparkSession
    ship(spark)
    weights = spark.sparkContext.broadcast(Labeller.load())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Labeller(weights.value)
        for batch in batches:
            texts = batch["text"].tolist()
            sequences = [leaves(t) for t in texts]
            marked = [s if any(leaf.path for leaf in s) else [] for s in sequences]
            kinds, clean = [], []
            for t, s, labels in zip(texts, marked, model.label(marked)):
                labels = [checked(leaf, k) for leaf, k in zip(s, labels)]
                kinds.append((["markup"] if any(labels) else []) + [LABELS[k] for k in sorted(set(labels)) if k > 1])
                clean.append(rendered(t, s, labels))
            yield pd.DataFrame({"id": batch["id"], "field": batch["field"], "kinds": kinds, "clean": clean})

    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields)))
    kind = df.select(id_col).schema[0].dataType
    rows = df.select(F.col(id_col).cast("string").alias("id"), each.alias("_f")).select("id", "_f.field", "_f.text").where("text is not null")
    return rows.mapInPandas(run, "id string, field string, kinds array<string>, clean string").select(F.col("id").cast(kind).alias(id_col), "field", "kinds", "clean")
