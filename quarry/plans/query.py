"""Query text -> terms.  Pure Python on the driver; see ``patterns`` for the Columns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from quarry import model as M

# Characters that a query loses, and those that a bare word loses at its edges.
_LOST = dict.fromkeys([*range(0x00, 0x09), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F])
_EDGES = " \t\r\n,;:!"


class QueryError(ValueError):
    """``code`` is query_empty, query_too_long or query_too_complex."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass(frozen=True)
class Term:
    text: str
    phrase: bool = False

    @property
    def glob(self) -> bool:
        return "*" in self.text or "?" in self.text

    @property
    def runs(self) -> tuple[str, ...]:
        """The literal runs between wildcards, longest first."""
        found = self.text.replace("?", "*").split("*") if self.glob else [self.text]
        return tuple(sorted(filter(None, dict.fromkeys(found)), key=len, reverse=True))

    @property
    def wildcards(self) -> int:
        return self.text.count("*") + self.text.count("?")

    @property
    def fragments(self) -> tuple[str, ...]:
        """Runs long enough for a substring prefilter."""
        return tuple(dict.fromkeys(r[: M.MAX_FRAGMENT] if self.glob else r for r in self.runs if len(r) >= M.INDEXED_FRAGMENT))


@dataclass(frozen=True)
class Parsed:
    terms: tuple[Term, ...]
    warnings: tuple[str, ...] = ()


def _scan(query: str) -> Iterator[Term]:
    """Terms from left to right: a closed pair of quotes holds a phrase, everything else is cut at blanks."""
    at = 0
    while at < len(query):
        close = query.find('"', at + 1) if query[at] == '"' else -1
        if close >= 0:
            yield Term(query[at + 1 : close].strip(), phrase=True)
            at = close + 1
        else:
            word = query[at:].split(maxsplit=1)[0] if not query[at].isspace() else ""
            yield Term(word.strip(_EDGES))
            at += len(word) or 1


class _Budget:
    """Takes the terms of one query and refuses the one that is too many."""

    def __init__(self):
        self.terms: list[Term] = []
        self.wildcards = 0

    def take(self, term: Term) -> None:
        if not term.text:
            return
        self.terms.append(term)
        self.wildcards += term.wildcards
        if len(self.terms) > M.MAX_TERMS or self.wildcards > M.MAX_WILDCARDS or term.wildcards > M.MAX_WILDCARDS_PER_TERM:
            raise QueryError("query_too_complex")


def parse(raw: str, *, exact_phrase: bool = False) -> Parsed:
    """The query's terms; a query of edge characters alone is a phrase, as is any query where ``exact_phrase``."""
    if len(raw) > M.MAX_QUERY_LENGTH:
        raise QueryError("query_too_long")
    query, budget = raw.translate(_LOST).strip(), _Budget()
    if exact_phrase:
        budget.take(Term(query.replace('"', "").strip(), phrase=True))
    else:
        for term in _scan(query):
            budget.take(term)
        if not budget.terms:
            budget.take(Term(query, phrase=True))
    if not budget.terms:
        raise QueryError("query_empty")
    unindexed = [t for t in budget.terms if not t.fragments]
    return Parsed(tuple(budget.terms), ("short_term_scan",) if unindexed else ())
