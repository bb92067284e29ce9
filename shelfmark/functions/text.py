"""Text functions as column expressions; everything stays in the JVM but for entity decoding."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Analyzer of the fielded index: words of letters and digits, inner apostrophes and dots kept.
WORD = r"[\p{L}\p{N}]+(?:['’.][\p{L}\p{N}]+)*"
#: Tokens of the TF-IDF index: ASCII letters and digits; accented letters split words.
TERM = "[a-zA-Z0-9]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokenize(c: Column | str) -> Column:
    """ASCII alphanumeric tokens, cut before lower-casing; a null text has no tokens."""
    found = F.regexp_extract_all(_col(c), F.lit(f"({TERM})"), 1)
    return F.coalesce(F.transform(found, F.lower), F.array().cast("array<string>"))


def analyze(c: Column | str) -> Column:
    """Tokens of the fielded index: lower-case words with inner apostrophes or dots."""
    return F.coalesce(F.regexp_extract_all(F.lower(_col(c)), F.lit(f"({WORD})"), 1), F.array().cast("array<string>"))


def doc_text(*parts: Column | str) -> Column:
    """Non-empty parts joined by a blank; arrays are joined the same way."""
    return F.concat_ws(" ", *(F.nullif(_col(p), F.lit("")) for p in parts))


def unescape(c: Column | str) -> Column:
    """Character entities decoded (the full HTML 5 table): an Arrow batch goes to Python and back."""

    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda t: html.unescape(t) if t is not None and "&" in t else t)

    return F.pandas_udf(decode, "string")(_col(c))


#: The entities that the native decoder knows; the last must stay last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&pound;", "£"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape_basic(c: Column | str) -> Column:
    """The commonest entities decoded without leaving the JVM."""
    out = _col(c)
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def strip_tags(c: Column | str) -> Column:
    """Script, style and comments dropped; tags become blanks; entities are left alone."""
    out = _col(c)
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        out = F.regexp_replace(out, pattern, " ")
    return out


def strip_html(c: Column | str, decode=unescape_basic) -> Column:
    """Plain text of a markup block: tags dropped, entities decoded, a leading ingredient label dropped, white space collapsed, ` .;,[]` trimmed off."""
    out = F.regexp_replace(decode(strip_tags(c)), "[ \r\n]", " ")
    out = F.regexp_replace(out, r"(?i)^\s*ingredients?\s*[:\-–—]\s*", "")
    return F.btrim(F.regexp_replace(out, r"\s+", " "), F.lit(" .;,[]"))


def normalize_ws(c: Column | str) -> Column:
    """Lower case, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"\s+", " "))


def normalize_alnum(c: Column | str) -> Column:
    """Lower case; every run of other characters than a-z and 0-9 becomes one blank; trimmed."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", " "))


def main_keyword(c: Column | str) -> Column:
    """What stands before the first ``&``, ``and`` or ``-`` word of a category; '' where a hyphen comes first."""
    return F.trim(F.regexp_extract(_col(c), r"^([^&\-]+?)(?:\s+(?:&|and|-)|\s*$)", 1))


def blank_to_null(c: Column | str) -> Column:
    """Null for null, empty and blank texts; other texts untrimmed."""
    return F.when(F.length(F.trim(_col(c))) > 0, _col(c))


def dedupe_key(c: Column | str) -> Column:
    """Key of a name for first-occurrence deduplication; null when nothing is left."""
    return F.nullif(normalize_ws(unescape_basic(_col(c))), F.lit(""))


def comparable(c: Column | str) -> Column:
    """Scalar as the accuracy test compares it: markup and entities out, spacing and case folded; null stays null."""
    return normalize_ws(strip_html(_col(c)))


def unit_pair(c: Column | str) -> Column:
    """``0.36/100g`` as a struct of price and unit: '' where a side is missing, null for null."""
    price = F.regexp_extract(_col(c), r"^\s*([0-9]+(?:\.[0-9]+)?)\s*/", 1)
    unit = F.regexp_extract(_col(c), r"/\s*([^/]*?)\s*$", 1)
    return F.when(_col(c).isNotNull(), F.struct(price.alias("price"), unit.alias("unit")))


def flags(names: str | list[str]) -> str:
    """Regular-expression flags by letter or name (I or IGNORECASE, S or DOTALL, M, U, X or VERBOSE) as an inline prefix."""
    listed = names if isinstance(names, list) else names.split("|")
    letters = {n.strip().upper()[:1].translate(str.maketrans("DV", "SX")) for n in listed if n.strip()}
    kept = "".join(sorted(letters & set("ISMUX"))).lower()
    return f"(?{kept})" if kept else ""


def sha_prefix(c: Column | str, n: int = 12) -> Column:
    return F.substring(F.sha2(_col(c), 256), 1, n)


def page_file_name(ts: Column | str, url: Column | str, page: Column | str) -> Column:
    """``{ts}_{hash of url}_{hash of page}.html``"""
    return F.concat(F.concat_ws("_", _col(ts).cast("string"), sha_prefix(url), sha_prefix(page)), F.lit(".html"))


def stable_id(c: Column | str) -> Column:
    """A non-negative 63-bit id of a string."""
    return F.xxhash64(_col(c)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
