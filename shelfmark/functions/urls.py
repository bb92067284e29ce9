"""Links and addresses as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HREF = r"""(?is)href=["']([^"']+)["']"""


def links(page: Column) -> Column:
    """Every ``href`` of a page, in order."""
    return F.coalesce(F.regexp_extract_all(page, F.lit(HREF), 1), F.array().cast("array<string>"))


def normalize(url: Column) -> Column:
    """Scheme and host in lower case, fragment dropped, an empty path becomes ``/``, the query is kept; null unless absolute."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    root = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1)
    rest = F.substring(bare, F.length(root) + 1, F.lit(1_000_000))
    path = F.when((rest == "") | rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(root != "", F.concat(F.lower(root), path))


def without_dots(url: Column) -> Column:
    """``.`` and ``..`` segments of an address's path resolved; ``..`` at the root goes nowhere."""
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    tail = F.regexp_extract(url, r"([?#].*)$", 1)
    path = F.substr(url, F.length(root) + 1, F.length(url) - F.length(root) - F.length(tail))
    parts = F.split(F.substr(path, F.lit(2)), "/")
    text = F.array().cast("array<string>")
    kept = F.aggregate(parts, text, lambda a, p: F.when(p == ".", a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    # A path that ends in such a segment is a folder.
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(/|$)") & (root != ""), F.concat(root, F.lit("/"), F.array_join(kept, "/"), tail)).otherwise(url)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def base_parts(base: Column) -> Column:
    """What links are resolved against: ``(url, root, scheme, page, folder)`` of a page's address."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(page == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_extract(page, r"^(.*/)", 1))
    return F.struct(base.alias("url"), root.alias("root"), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1).alias("scheme"), page.alias("page"), folder.alias("folder"))


def resolve_with(parts: Column, link: Column) -> Column:
    """As ``resolve``, given the ``base_parts`` of the page."""
    dotted = lambda u: F.when(link.contains("/.") | link.startswith("."), let(u, without_dots)).otherwise(u)
    full = (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(parts["scheme"], link))
        .when(link.startswith("/"), dotted(F.concat(parts["root"], link)))
        .when(link.startswith("?"), F.concat(parts["page"], link))
        .when(link.startswith("#") | (link == ""), parts["url"])
        .otherwise(dotted(F.concat(parts["folder"], link)))
    )
    return let(full, normalize)


def resolve(base: Column, link: Column) -> Column:
    """``link`` as an absolute, normalised address seen from ``base``. Links with a host of their own keep their segments as they are."""
    return let(base_parts(base), lambda parts: resolve_with(parts, link))


def in_scope(url: Column, pattern: str) -> Column:
    """Whether an address lies in the crawl's scope (an anchored, case-insensitive pattern)."""
    return url.rlike(f"(?i)^(?:{pattern})")


def is_product_page(url: Column) -> Column:
    return url.contains("/products/")
