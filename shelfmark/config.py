"""Site rules: the patterns by which a shop's pages are read. All are parameters; these defaults fit plain shop pages."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class SiteRules:
    scope: str = r"https?://[\w.-]+/.*"
    body: str = r"<body[^>]*>(.*)</body>"
    name: str = r"<h1[^>]*>(.*?)</h1>"
    #: Links of the form "View all X"; the first names the category, the second the brand.
    trail: str = r"<a[^>]*>\s*View all ([^<]+)</a>"
    #: Tried in order; the first that matches gives the price.
    prices: tuple[str, ...] = (r"</h1>\s*<p[^>]*>(?:£|&pound;|GBP\s?)(\d[\d.]*)</p>", r"<meta[^>]*\bprice[^>]*content=[\"'](\d[\d.]*)[\"']", r"\bprice\b[^<>]{0,40}>\s*(?:£|&pound;)?(\d[\d.]*)<")
    unit_pairs: tuple[str, ...] = (r"</p>\s*<p>(?:£|&pound;|GBP\s?)?(\d[\d.]*\s*/[^<]{1,20})</p>",)
    currency: str = "£"
    ingredients: str = r"<h[1-6][^>]*>Ingredients</h[1-6]>\s*<div[^>]*>(.*?)</div>"
    description: str = r"<h[1-6][^>]*>Description</h[1-6]>\s*<div[^>]*>(.*?)</div>\s*(?:<h|<a|<p|</|<div)"
    highlights: str = r"<h[1-6][^>]*>Highlights</h[1-6]>\s*<ul[^>]*>(.*?)</ul>"
    nutrients: dict[str, str] = field(
        default_factory=lambda: {
            n: rf"<th[^>]*>{label}</th>\s*<td[^>]*>(.*?)</td>"
            for n, label in (("energy", "Energy"), ("fat", "Fat"), ("protein", "Protein"), ("salt", "Salt"), ("carbs", "Carbohydrate"), ("fibre", "Fibre"))
        }
    )

    @classmethod
    def load(cls, path: str) -> SiteRules:
        """Rules from a JSON object; keys left out keep their defaults."""
        given = json.loads(Path(path).read_text(encoding="utf-8"))
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


#: Substrings by which a blocked page is known, compared without case.
BLOCKED = ("access to this page has been denied", "verify you are a person", "are you a robot", "captcha")
