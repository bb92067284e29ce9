"""Keeping the main body of web pages: host suffix arrays over line streams.

Pages of one host (cut into shards of a bounded number of pages by a hash of their content)
are concatenated as streams of line tokens. Sorting the suffixes by prefix doubling gives, at
each doubling, the groups of equal substrings, whose distinct pages are summed over all shards
of the host; a long substring, or one on a good part of the host's pages, that occurs on
distinct pages is boilerplate and covers its lines. What
is left are unique runs, the candidates on every page. An exact check follows: runs count from
the page's title on, lines that are links are no content, stock phrases stay in a section that
holds a unique run, and the prices beside the title and the sections with listed titles are added.
"""

from __future__ import annotations

import hashlib
import html
import pickle
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed, ship

#: Pages that one suffix array holds, about.
SHARD_PAGES = 512
#: Pages that a long repeat, and a common one of any length, is on at least, whatever the size of the host.
LEAST, LEAST_COMMON = 3, 2
#: A repeat is long from this many words on.
LONG_WORDS = 6
#: A shorter repeat is boilerplate when it is on this share of the host's pages; so is a heading, whatever its length, on the second.
COMMON_SHARE, HEADING_SHARE = 0.1, 0.2

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\w[^>]*>|<\s*(?P<close>/?)\s*(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>", re.S)
_SILENT = re.compile(r"<\s*(script|style|noscript|head|template|svg)\b.*?(?:<\s*/\s*\1\s*>|(?=<\s*body\b)|$)", re.S | re.I)
_CLASS = re.compile(r"\bclass\s*=", re.I)
_SPACE = re.compile(r"\s+")
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCKS = _HEADINGS | set(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form header hr html input legend li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = {"br", "hr", "input"}
#: Titles of the sections of a product page.
SECTIONS = {"highlights", "description", "ingredients", "nutrition"}
_PRICE_WORDS = set("gbp p pence poa per each ea item items piece pack kg kilo g gram grams ml cl l ltr litre litres oz lb lbs pint pints fl dozen unit".split())
#: What an opening tag closes by itself.
_CLOSES = {
    "li": {"li", "p"}, "p": {"p"}, "div": {"p"}, "ul": {"p"}, "ol": {"p"}, "table": {"p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "tr", "p"},
    **{h: {"p", *_HEADINGS} for h in _HEADINGS}, "section": {"p"}, "main": {"p"}, "aside": {"p"}, "footer": {"p"}, "nav": {"p"}, "form": {"p"}, "article": {"p"}, "header": {"p"},
}
#: Where the lines of a section lie, should its end tag be missing.
_INNER = {"table": {"td", "th"}, "ul": {"li"}, "ol": {"li"}}
#: Blocks that hold no content when opened after the title.
_FOREIGN = {"nav", "aside", "footer", "form", "button", "select"}
_SCOPE = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}


class Line(NamedTuple):
    text: str
    tag: str  # innermost block
    linked: bool  # all of it is link text
    path: tuple[tuple[int, str, bool], ...]  # open blocks as (serial, tag, has a class)


def host_of(page: str) -> str:
    """The host named at the end of the page's title, or '' where the page names none."""
    m = re.search(r"<title\b[^>]*>(.*?)</title", page, re.S | re.I)
    m = re.search(r"\|\s*([\w-]+(?:\.[\w-]+)+)\s*$", m.group(1)) if m else None
    return m.group(1).lower() if m else ""


def title_of(page: str) -> str:
    """The page's title without the host named at its end."""
    m = re.search(r"<title\b[^>]*>(.*?)</title", page, re.S | re.I)
    return _SPACE.sub(" ", html.unescape(re.sub(r"\|\s*[\w-]+(?:\.[\w-]+)+\s*$", "", m.group(1)))).strip() if m else ""


def lines_of(page: str) -> list[Line]:
    """The page's lines: text between two block-level tags, entities decoded, white space collapsed, not empty."""
    page = _SILENT.sub("", page)
    out: list[Line] = []
    open_blocks: list[tuple[int, str, bool]] = []
    held: list[tuple[str, bool]] = []
    links = serial = at = 0

    def end_line() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(t for t, _ in held))).strip()
        if text:
            solid = [linked for t, linked in held if _SPACE.sub("", html.unescape(t)) not in ("", "|", "·", "-", ">", "&gt;")]
            out.append(Line(text, open_blocks[-1][1] if open_blocks else "", bool(solid) and all(solid), tuple(open_blocks)))
        held.clear()

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            held.append((page[at : m.start()], links > 0))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag == "a":
            links = max(0, links - 1) if m["close"] else links + 1
        if tag not in _BLOCKS:
            continue
        end_line()
        if tag in _VOID:
            continue
        if m["close"]:
            if any(t == tag for _, t, _ in open_blocks):
                while open_blocks.pop()[1] != tag:
                    pass
                links = 0
            continue
        shut = _CLOSES.get(tag, ())
        for k in range(len(open_blocks) - 1, -1, -1):
            if open_blocks[k][1] in shut:
                del open_blocks[k:]
                break
            if open_blocks[k][1] in _SCOPE.get(tag, {"div", "section", "main", "article", "aside", "td", "li", "body", "table", "ul", "ol"}):
                break
        serial += 1
        open_blocks.append((serial, tag, bool(_CLASS.search(m["attrs"] or ""))))
    if at < len(page):
        held.append((page[at:], links > 0))
    end_line()
    return out


class _Stream(NamedTuple):
    """Pages of (line, whether it is a heading) as one stream of line tokens, a separator after each page."""

    tokens: np.ndarray  # separators are negative
    page: np.ndarray
    heading: np.ndarray
    total: np.ndarray  # words before each position
    line: np.ndarray  # hash of the line, the same in every shard


def _stream(pages: list[list[tuple[str, bool]]]) -> _Stream:
    """Digits do not tell short lines apart (prices, counters)."""
    ids: dict[str, int] = {}
    tokens, page_of, words, heading = [], [], [], []
    for p, lines in enumerate(pages):
        for t, is_heading in lines:
            masked = t.lower()
            if not is_heading and masked.count(" ") < 3:  # prices and counters
                masked = re.sub(r"\d+", "0", masked)
            heading.append(is_heading)
            tokens.append(ids.setdefault(masked, len(ids)))
            page_of.append(p)
            words.append(len(masked.split()))
        tokens.append(-1 - p)  # a separator that occurs once
        page_of.append(p)
        words.append(0)
        heading.append(False)
    s = np.array(tokens, np.int64)
    hashes = np.array([int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for t in ids] or [0], np.uint64)
    return _Stream(s, np.array(page_of, np.int64), np.array(heading, bool), np.concatenate(([0], np.cumsum(words))), hashes[np.maximum(s, 0)])


def _doubled(rank: np.ndarray, length: int) -> np.ndarray:
    """The next doubling of the suffix order."""
    n = len(rank)
    second = np.concatenate((rank[length:] + 1, np.zeros(min(length, n), np.int64)))[:n]
    return np.unique(rank * (n + 1) + second, return_inverse=True)[1].astype(np.int64)


def _support(rank: np.ndarray, page: np.ndarray) -> np.ndarray:
    """On how many pages each rank occurs."""
    n_pages = int(page.max()) + 1
    return np.bincount(np.unique(rank * n_pages + page) // n_pages, minlength=int(rank.max()) + 1)


def _runs(stream: _Stream, long_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each doubling (length, rank of the run at each position, its hash, positions to look at).

    Runs across a page's end are left out, and so is a run whose halves are both long: wherever
    it repeats they repeat, and cover the same lines (a half that starts with a heading may not).
    """
    n, length = len(stream.tokens), 1
    rank = np.unique(stream.tokens, return_inverse=True)[1].astype(np.int64)
    run = stream.line.copy()
    at = np.flatnonzero(stream.tokens >= 0)
    while len(at):
        yield length, rank, run, at
        at = at[at + 2 * length <= n]
        at = at[(stream.page[at] == stream.page[at + 2 * length - 1]) & (stream.tokens[at + 2 * length - 1] >= 0)]
        middle = stream.total[at + length]
        at = at[(middle - stream.total[at] < long_words) | (stream.total[at + 2 * length] - middle < long_words) | stream.heading[at + length]]
        rank = _doubled(rank, length)
        second = np.concatenate((run[length:], np.zeros(min(length, n), np.uint64)))[:n]
        run = (run * np.uint64(0x9E3779B97F4A7C15)) ^ (second + np.uint64(length))
        run = (run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        run ^= run >> np.uint64(32)
        length *= 2


def run_counts(pages: list[list[tuple[str, bool]]], long_words: int = LONG_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a shard's runs of lines and on how many of its pages each is. Equal pages must be given once."""
    stream = _stream(pages)
    found, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, rank, run, at in _runs(stream, long_words):
        ranks, first = np.unique(rank[at], return_index=True)
        found.append(run[at[first]].view(np.int64))
        counts.append(_support(rank, stream.page)[ranks])
    return np.concatenate(found), np.concatenate(counts)


def covered_by_counts(
    pages: list[list[tuple[str, bool]]], runs: np.ndarray, counts: np.ndarray, n_pages: int, long_words: int = LONG_WORDS, share: float = COMMON_SHARE, heading_share: float = HEADING_SHARE, least: int = LEAST
) -> list[np.ndarray]:
    """As covered_by_repeats, by the pages of a whole host: those of each run (a hash of run_counts; those on one page may be missing), and all."""
    stream = _stream(pages)
    order = np.argsort(runs)
    runs, counts = runs[order], counts[order]
    common = np.where(stream.heading, max(least, heading_share * n_pages), max(LEAST_COMMON, share * n_pages))
    cover = np.zeros(len(stream.tokens) + 1, np.int64)
    own = np.zeros(len(stream.tokens), np.int64)
    for length, _, run, at in _runs(stream, long_words):
        if not len(runs):
            break
        hashes = run[at].view(np.int64)
        k = np.minimum(np.searchsorted(runs, hashes), len(runs) - 1)
        support = np.where(runs[k] == hashes, counts[k], 0)
        if length == 1:
            own[at] = support
        repeated = (support >= least) & (stream.total[at + length] - stream.total[at] >= long_words) | (support >= common[at])
        cover += np.bincount(at[repeated], minlength=len(cover)) - np.bincount(at[repeated] + length, minlength=len(cover))
    return _by_page(pages, (np.cumsum(cover[:-1]) > 0) & (~stream.heading | (own >= common)))


def _by_page(pages: list[list[tuple[str, bool]]], mask: np.ndarray) -> list[np.ndarray]:
    out, k = [], 0
    for lines in pages:
        out.append(mask[k : k + len(lines)])
        k += len(lines) + 1
    return out


def covered_by_repeats(pages: list[list[tuple[str, bool]]], long_words: int = LONG_WORDS, share: float = COMMON_SHARE, heading_share: float = HEADING_SHARE) -> list[np.ndarray]:
    """For each page of (line, whether it is a heading), which lines lie in a repeated substring of these pages alone.

    Equal pages must be given once. Headings only count as covered when they are common by
    themselves. The whole-host form is covered_by_counts.
    """
    s, at, is_heading, total, _ = _stream(pages)
    n = len(s)
    cover = np.zeros(n + 1, np.int64)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    least = 2 if len(pages) < 30 else LEAST
    common = np.where(is_heading, max(3, heading_share * len(pages)), max(least, share * len(pages)))
    own = None
    length = 1
    while n and length < n:
        support = _support(rank, at)[rank]
        end = np.minimum(np.arange(n) + length, n)
        repeated = (support >= least) & (total[end] - total[:-1] >= long_words) | (support >= common)
        repeated &= s >= 0
        if own is None:
            own = support
        cover += np.bincount(np.flatnonzero(repeated), minlength=n + 1) - np.bincount(end[repeated], minlength=n + 1)
        if not (support >= least).any():
            break
        rank = _doubled(rank, length)
        length *= 2
    mask = np.cumsum(cover[:-1]) > 0
    if own is not None:
        mask &= ~is_heading | (own >= common)
    return _by_page(pages, mask)


def _own_class(line: Line, after: int) -> bool:
    """Whether a block with a class, opened after block ``after``, holds the line."""
    return any(serial > after and classed for serial, _, classed in line.path)


def _priced(text: str) -> bool:
    """Whether a line holds nothing but a price, a unit, or both."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    return len(text) < 40 and all(w in _PRICE_WORDS for w in words) and bool(words or re.search(r"\d", text))


def main_lines(lines: list[Line], covered: np.ndarray, title: str = "", seen: bool = False) -> list[int]:
    """Which lines are the main body, given which are covered by repeats; ``title`` stands in for a missing h1.

    Lines that no repeat covers are candidates on every page, from the title on. A covered line
    is judged in its context: it stays in the contents of a section of which a line is uncovered.
    The check then adds title, prices and the sections with listed titles, and removes links,
    what lies in menus, forms, asides or footers, and on product pages lone prices and foreign blocks.
    Without ``seen``, ``covered`` comes from no comparison of pages: then a product page has listed sections only.
    """
    start = next((i for i, ln in enumerate(lines) if ln.tag == "h1"), None)
    if start is None and title:
        start = next((i for i, ln in enumerate(lines) if not ln.linked and ln.text.casefold() == title.casefold()), None)
    if start is None:
        return []
    opened = lines[start].path[-1][0] if lines[start].path else 0
    prices = []
    for i in range(start + 1, min(start + 3, len(lines))):
        if lines[i].tag != "p" or lines[i].linked or not _priced(lines[i].text) or (not prices and not re.search(r"\d|poa", lines[i].text.lower())):
            break
        prices.append(i)
    listed = {i for i, ln in enumerate(lines) if i > start and not ln.linked and ln.text.casefold().rstrip(":") in SECTIONS}
    product = bool(prices) or len(listed) > 1
    foreign = [any(serial > opened and tag in _FOREIGN for serial, tag, _ in ln.path) for ln in lines]
    keep = {start, *prices}
    for h in range(start + 1, len(lines)):
        if lines[h].tag not in _HEADINGS and (h not in listed or h in keep):
            continue
        inside = _contents(lines, h)
        if h in listed:
            keep.update([h, *inside])
            continue
        inside = [i for i in inside if not lines[i].linked and not foreign[i]]
        if product and not seen:
            continue
        if not lines[h].linked and not foreign[h] and any(not covered[i] and not _priced(lines[i].text) for i in inside):
            keep.update([h, *inside])
    for i in range(start + 1, len(lines)):
        ln = lines[i]
        if covered[i] or ln.linked or foreign[i]:
            continue
        if product and (not seen or ln.tag in _HEADINGS or _priced(ln.text) or _own_class(ln, opened)):
            continue
        if ln.tag == "p" or ln.tag in _HEADINGS or product:
            keep.add(i)
    return sorted(keep)


def _contents(lines: list[Line], h: int) -> list[int]:
    """The lines of the section with the title ``h``: those in the first block opened after it."""
    head = lines[h].path[-1][0] if lines[h].path else 0
    content = next((b for b in lines[h + 1].path if b[0] > head), None) if h + 1 < len(lines) else None
    if content is None:
        return []
    inner = _INNER.get(content[1])
    out = []
    for i in range(h + 1, len(lines)):
        ln = lines[i]
        if ln.tag in _HEADINGS or content not in ln.path or _own_class(ln, content[0]) or inner and ln.tag not in inner:
            break
        out.append(i)
    return out


def main_body(df: DataFrame, name_col: str = "source_file", html_col: str = "html") -> DataFrame:
    """Rows ``(name, line_no, line)``: the main body's lines of every page, numbered from 1 within the page.

    Null or blank pages and pages without a title (an h1, or a line equal to the title element) give no row. A page stored several times
    counts once as evidence, and each of its names gets its lines once. Pages that name no
    host form one group. The rules are the same for any number of pages; what no other page repeats
    stays. Pages of any length are read whole; other columns are ignored.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(name_col).alias("_name"), F.col(html_col).alias("_html")).where(F.length(F.trim("_html")) > 0).withColumn("_page", F.md5("_html"))
    pages = rows.select("_page", "_html").dropDuplicates(["_page"])
    title = F.regexp_extract("_html", r"(?is)<title\b[^>]*>[^<]*\|\s*([\w-]+(?:\.[\w-]+)+)\s*</title", 1)
    pages = pages.withColumn("_host", F.lower(title))
    counts = pages.groupBy("_host").agg(F.count("*").alias("_n"))
    shard = F.pmod(F.xxhash64("_page"), F.greatest(F.lit(1), F.ceil(F.col("_n") / SHARD_PAGES))).cast("int")
    pages = pages.join(counts, "_host").select("_host", shard.alias("_shard"), "_n", "_page", "_html")
    spark = df.sparkSession  # few bytes, much work: keep the pages, then the shards apart
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["_title"] = [title_of(h) for h in b["_html"]]
            b["_lines"] = [pickle.dumps([tuple(ln) for ln in lines_of(h)]) for h in b["_html"]]
            yield b.drop(columns="_html")

    parsed = pages.repartition(parts, "_page").mapInPandas(parse, "_host string, _shard int, _n long, _page string, _title string, _lines binary")
    parsed = checkpointed(parsed.repartition(parts, "_host", "_shard"))

    def streams(shard: pd.DataFrame) -> tuple[list[list[Line]], list[list[tuple[str, bool]]]]:
        lines = [[Line(*x) for x in pickle.loads(p)] for p in shard["_lines"]]
        return lines, [[(ln.text, ln.tag in _HEADINGS) for ln in p] for p in lines]

    def counted(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        runs, n = run_counts(streams(shard)[1])
        return pd.DataFrame({"_host": key[0], "_shard": key[1], "run": runs, "n": n})

    # Evidence of the whole host, back to the shards that hold the run.
    runs = parsed.groupBy("_host", "_shard").applyInPandas(counted, "_host string, _shard int, run long, n long")
    runs = runs.groupBy("_host", "run").agg(F.sum("n").alias("n"), F.collect_list("_shard").alias("_shards")).where(F.col("n") >= LEAST_COMMON)
    runs = runs.select("_host", F.explode("_shards").alias("_shard"), "run", "n")

    def bodies(shard: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(shard):
            lines_by_page, stream = streams(shard)
            n_pages = int(shard["_n"].iloc[0])
            masks = covered_by_counts(stream, known["run"].to_numpy(np.int64), known["n"].to_numpy(np.int64), n_pages)
            for page, title, lines, mask in zip(shard["_page"], shard["_title"], lines_by_page, masks):
                out.append((page, [lines[i].text for i in main_lines(lines, mask, title, True)]))
        return pd.DataFrame(out, columns=["_page", "_body"])

    found = parsed.groupBy("_host", "_shard").cogroup(runs.groupBy("_host", "_shard")).applyInPandas(bodies, "_page string, _body array<string>")
    return rows.select("_name", "_page").distinct().join(found, "_page").select(F.col("_name").alias(name_col), F.posexplode("_body").alias("_at", "line")).select(name_col, (F.col("_at") + 1).alias("line_no"), "line")


def line_md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()
