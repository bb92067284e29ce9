"""Query trees of the fielded search."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Term:
    """A word in any of the fields; scores add up over fields."""

    text: str
    fields: tuple[str, ...] = ()
    boost: float = 1.0


@dataclass(frozen=True)
class Fuzzy:
    """All words within ``edits`` of ``text`` (at most ``expansions`` per field, nearest first)."""

    text: str
    fields: tuple[str, ...] = ()
    edits: int = 2
    expansions: int = 50


@dataclass(frozen=True)
class Phrase:
    """Words in order in one field; with ``slop``, moved by at most so many positions in all."""

    words: tuple[str, ...]
    fields: tuple[str, ...] = ()
    slop: int = 0


@dataclass(frozen=True)
class Range:
    """A catalogue column between two bounds, both included; null never matches."""

    column: str
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Keyword:
    """A verbatim catalogue column equal to a value, letter case disregarded unless ``exact``."""

    column: str
    value: str
    exact: bool = False


@dataclass(frozen=True)
class Bool:
    """All of ``must``; if there is none, any of ``should``; none of ``must_not``."""

    must: tuple[Node, ...] = ()
    should: tuple[Node, ...] = ()
    must_not: tuple[Node, ...] = ()


Node = Term | Fuzzy | Phrase | Range | Keyword | Bool

#: Most clauses that one query may hold.
MAX_CLAUSES = 4096


@dataclass
class Leaves:
    """Clauses of a tree in the order they were met."""

    nodes: list[Node] = field(default_factory=list)

    def add(self, node: Node) -> int:
        self.nodes.append(node)
        if len(self.nodes) > MAX_CLAUSES:
            raise ValueError(f"a query holds at most {MAX_CLAUSES} clauses")
        return len(self.nodes) - 1
