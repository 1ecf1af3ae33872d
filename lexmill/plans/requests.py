"""Requests: what to search, how much of it to return, and how."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum

from ..errors import InvalidArgument, InvalidState
from ..functions.bm25 import Bm25Config
from ..schema import TextField
from .predicates import Query
from .ranked import SearchQuery, TextQuery


class TotalHitsMode(Enum):
    DISABLED = "disabled"
    EXACT = "exact"


@dataclass(frozen=True, eq=False)
class SearchRequest:
    """A ranked query, an optional filter that decides who may match but gives no score, and a limit."""

    query: SearchQuery | None = None
    filter: Query | None = None
    limit: int = 10
    config: Bm25Config = field(default_factory=Bm25Config)

    def __post_init__(self) -> None:
        if self.limit <= 0:
            raise InvalidArgument(f"limit {self.limit}")
        if self.query is None:
            raise InvalidState("a request needs a query")

    def with_limit(self, limit: int) -> SearchRequest:
        return replace(self, limit=limit)


def ranked_request(f: TextField, text: str, limit: int = 10, filter: Query | None = None, config: Bm25Config | None = None) -> SearchRequest:
    """The older single-field form: a text query."""
    return SearchRequest(TextQuery(f, text), filter, limit, config or Bm25Config())


@dataclass(frozen=True)
class SearchCursor:
    """Where a page ended. It is good for the engine, request and snapshot it came from."""

    engine: str
    request: int
    version: int
    score: float
    doc_ord: int


@dataclass(frozen=True, eq=False)
class SearchPageRequest:
    search: SearchRequest
    after: SearchCursor | None = None
    totals: TotalHitsMode = TotalHitsMode.DISABLED

    def next(self, cursor: SearchCursor) -> SearchPageRequest:
        return replace(self, after=cursor)


@dataclass(frozen=True, eq=False)
class HighlightedSearchRequest:
    search: SearchRequest
    fields: tuple[TextField, ...] = ()
    context: int = 40
    max_fragments: int = 3

    def __post_init__(self) -> None:
        if not self.fields:
            raise InvalidState("highlighting needs a field")
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise InvalidArgument("a field is there twice")
        if self.context < 0 or self.max_fragments < 1:
            raise InvalidArgument(f"context {self.context}, fragments {self.max_fragments}")
