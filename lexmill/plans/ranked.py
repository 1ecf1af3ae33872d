"""Ranked queries: text, phrase, fuzzy, bool and boost.

A tree is first normalised (analysis on the driver, in builder order), then compiled to a pair of
Columns per node, matched and score, over the positions of each needed term. Where those come from,
from the text itself or from stored postings, is the caller's choice; scores are the same to the last bit, since they are
left folds in the terms' first-encounter order, never a shuffled sum.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument, InvalidState
from ..functions import bm25
from ..functions.analysis import Token
from ..functions.osa import auto_edits
from ..schema import TextField


class SearchQuery:
    def boost(self, factor: float) -> SearchQuery:
        if not (math.isfinite(factor) and factor > 0):
            raise InvalidArgument(f"boost {factor}")
        return BoostQuery(self, float(factor))


@dataclass(frozen=True, eq=False)
class TextQuery(SearchQuery):
    field: TextField
    text: str


@dataclass(frozen=True, eq=False)
class PhraseQuery(SearchQuery):
    field: TextField
    text: str
    slop: int = 0


@dataclass(frozen=True, eq=False)
class FuzzyQuery(SearchQuery):
    field: TextField
    text: str


@dataclass(frozen=True, eq=False)
class BoostQuery(SearchQuery):
    child: SearchQuery
    factor: float


@dataclass(frozen=True, eq=False)
class BoolQuery(SearchQuery):
    required: tuple[SearchQuery, ...]
    optional: tuple[SearchQuery, ...]
    least: int | None = None

    @property
    def threshold(self) -> int:
        return self.least if self.least is not None else 0 if self.required else 1


class BoolBuilder:
    def __init__(self) -> None:
        self._must: list[SearchQuery] = []
        self._should: list[SearchQuery] = []
        self._least: int | None = None

    def must(self, query: SearchQuery) -> BoolBuilder:
        self._must.append(query)
        return self

    def should(self, query: SearchQuery) -> BoolBuilder:
        self._should.append(query)
        return self

    def minimum_should_match(self, n: int) -> BoolBuilder:
        if n < 0:
            raise InvalidArgument(f"minimum {n}")
        self._least = n
        return self

    def build(self) -> BoolQuery:
        if not self._must and not self._should:
            raise InvalidState("a bool query needs a clause")
        if self._least is not None and self._least > len(self._should):
            raise InvalidArgument(f"minimum {self._least} of {len(self._should)} clauses")
        if self._least == 0 and not self._must:
            raise InvalidArgument("minimum 0 needs a must clause")
        return BoolQuery(tuple(self._must), tuple(self._should), self._least)


def text(f: TextField, query: str) -> SearchQuery:
    return TextQuery(f, query)


def phrase(f: TextField, query: str, slop: int = 0) -> SearchQuery:
    if slop < 0:
        raise InvalidArgument(f"slop {slop}")
    return PhraseQuery(f, query, slop)


def fuzzy(f: TextField, query: str) -> SearchQuery:
    return FuzzyQuery(f, query)


def bool_() -> BoolBuilder:
    return BoolBuilder()


# --- normalised trees


@dataclass(frozen=True)
class Slot:
    """Alternatives at one place of a phrase, ``at`` words behind its first."""

    at: int
    terms: tuple[str, ...]


@dataclass(frozen=True, eq=False)
class Node:
    children: tuple[Node, ...] = ()


@dataclass(frozen=True, eq=False)
class TextNode(Node):
    field: TextField = None  # type: ignore[assignment]
    terms: tuple[str, ...] = ()


@dataclass(frozen=True, eq=False)
class PhraseNode(TextNode):
    slots: tuple[Slot, ...] = ()
    slop: int = 0


@dataclass(frozen=True, eq=False)
class FuzzyNode(TextNode):
    """``terms`` are the expansions, nearest first, with their distances."""

    term: str | None = None
    distances: tuple[int, ...] = ()


@dataclass(frozen=True, eq=False)
class BoostNode(Node):
    factor: float = 1.0


@dataclass(frozen=True, eq=False)
class BoolNode(Node):
    required: int = 0
    threshold: int = 0


Expand = Callable[[TextField, str], list[tuple[str, int]]]


def slots_of(tokens: list[Token]) -> tuple[Slot, ...]:
    by_place: dict[int, list[str]] = {}
    at = -1
    for t in tokens:
        at += t.increment
        by_place.setdefault(at, []).append(t.term)
    first = min(by_place, default=0)
    return tuple(Slot(p - first, tuple(dict.fromkeys(terms))) for p, terms in sorted(by_place.items()))


def normalise(query: SearchQuery, expand: Expand, check: Callable[[TextField, bool], None]) -> Node:
    """Analyse every leaf, in builder order. ``check(field, has_terms)`` raises for a field that isn't the schema's own or
    whose leaf has terms but no text index."""
    if isinstance(query, TextQuery):
        terms = tuple(query.field.analyzer.terms(query.text))
        check(query.field, bool(terms))
        return TextNode(field=query.field, terms=terms)
    if isinstance(query, PhraseQuery):
        tokens = query.field.analyzer.checked(query.text)
        check(query.field, bool(tokens))
        return PhraseNode(field=query.field, terms=tuple(dict.fromkeys(t.term for t in tokens)), slots=slots_of(tokens), slop=query.slop)
    if isinstance(query, FuzzyQuery):
        terms = query.field.analyzer.terms(query.text)
        if len(query.field.analyzer.tokens(query.text)) > 1:
            raise InvalidArgument(f"fuzzy text {query.text!r} has more than one token")
        check(query.field, bool(terms))
        found = expand(query.field, terms[0]) if terms else []
        return FuzzyNode(field=query.field, term=terms[0] if terms else None, terms=tuple(t for t, _ in found), distances=tuple(d for _, d in found))
    if isinstance(query, BoostQuery):
        return BoostNode((normalise(query.child, expand, check),), query.factor)
    if isinstance(query, BoolQuery):
        children = tuple(normalise(c, expand, check) for c in (*query.required, *query.optional))
        return BoolNode(children, len(query.required), query.threshold)
    raise InvalidArgument(f"no search query: {query!r}")


def leaves(node: Node) -> list[TextNode]:
    return [node] if isinstance(node, TextNode) else [x for c in node.children for x in leaves(c)]


def needed(node: Node) -> dict[TextField, list[str]]:
    """The terms that scoring needs, by field."""
    out: dict[TextField, list[str]] = {}
    for leaf in leaves(node):
        own = out.setdefault(leaf.field, [])
        own += [t for t in leaf.terms if t not in own]
    return out


def phrases(node: Node) -> list[PhraseNode]:
    return [x for x in leaves(node) if isinstance(x, PhraseNode)]


def is_empty(node: Node) -> bool:
    """Whether nothing can match, whatever the corpus."""
    if isinstance(node, TextNode):
        return not node.terms
    if isinstance(node, BoolNode):
        must, should = node.children[: node.required], node.children[node.required :]
        return any(is_empty(c) for c in must) or sum(not is_empty(c) for c in should) < node.threshold
    return is_empty(node.children[0])


@dataclass
class Statistics:
    """Corpus statistics of one field, over all its documents whatever a request filters."""

    stats: bm25.FieldStats
    df: dict[str, int] = field(default_factory=dict)


@dataclass
class Source:
    """Where a row's positions (of terms of phrases), frequencies and length are: Columns by field and term."""

    positions: Callable[[TextField, str], Column]
    frequency: Callable[[TextField, str], Column]
    length: Callable[[TextField], Column]


def phrase_slop(slots: tuple[Slot, ...], source: Source, f: TextField) -> Column:
    """The least number of extra words between the slots over all occurrences; null without one.

    From each place of the first slot the next is the earliest at its distance or more, and so on: its end is the
    earliest that is possible."""

    def places(slot: Slot) -> Column:
        lists = [source.positions(f, t) for t in slot.terms]
        return lists[0] if len(lists) == 1 else F.array_distinct(F.concat(*lists))

    first = F.transform(places(slots[0]), lambda p: F.struct(p.alias("start"), p.alias("at")))

    def follow(rows: Column, slot: Slot, gap: int) -> Column:
        where = places(slot)
        ahead = lambda s: F.array_min(F.filter(where, lambda q: q >= s["at"] + gap))
        moved = F.transform(rows, lambda s: F.struct(s["start"].alias("start"), ahead(s).alias("at")))
        return F.filter(moved, lambda s: s["at"].isNotNull())

    for before, slot in zip(slots[:-1], slots[1:], strict=True):
        first = follow(first, slot, slot.at - before.at)
    span = slots[-1].at
    return F.array_min(F.transform(first, lambda s: s["at"] - s["start"] - span))


def exact_phrase(slots: tuple[Slot, ...], source: Source, f: TextField) -> Column:
    """Whether the slots stand at their places."""

    def at(slot: Slot, start: Column) -> Column:
        any_ = [F.array_contains(source.positions(f, t), start + slot.at) for t in slot.terms]
        out = any_[0]
        for c in any_[1:]:
            out = out | c
        return out

    anchors = [source.positions(f, t) for t in slots[0].terms]
    starts = anchors[0] if len(anchors) == 1 else F.array_distinct(F.concat(*anchors))

    def all_at(start: Column) -> Column:
        out = F.lit(True)
        for slot in slots[1:]:
            out = out & at(slot, start)
        return out

    return F.exists(starts, all_at)


def compiled(node: Node, source: Source, statistics: dict[TextField, Statistics], config: bm25.Bm25Config) -> tuple[Column, Column]:
    """(matched, score); score is 0.0 where not matched."""
    if isinstance(node, TextNode):
        if not node.terms or node.field not in statistics or statistics[node.field].stats.documents == 0:
            return F.lit(False), F.lit(0.0)
        own = statistics[node.field]
        length = source.length(node.field)

        def one(term: str, weight: float = 1.0) -> tuple[Column, Column]:
            tf = source.frequency(node.field, term)
            score = bm25.term_score(tf, length, bm25.idf(own.stats, own.df.get(term, 0)), own.stats, config)
            return tf > 0, score if weight == 1.0 else score * F.lit(weight)

        if isinstance(node, PhraseNode):
            if any(all(own.df.get(t, 0) == 0 for t in s.terms) for s in node.slots):
                return F.lit(False), F.lit(0.0)
            hit = exact_phrase(node.slots, source, node.field) if node.slop == 0 else F.coalesce(phrase_slop(node.slots, source, node.field) <= node.slop, F.lit(False))
            hit = F.coalesce(hit, F.lit(False))
        elif isinstance(node, FuzzyNode):
            matched, score = F.lit(False), F.lit(0.0)
            for term, distance in zip(node.terms, node.distances, strict=True):
                sim = 1.0 - distance / max(len(term), len(node.term or ""))
                has, s = one(term, sim)
                if distance == 0:
                    exact = F.coalesce(has, F.lit(False)), s
                    rest = [one(t, 1.0 - d / max(len(t), len(node.term or ""))) for t, d in zip(node.terms, node.distances, strict=True) if d]
                    best, any_ = F.lit(0.0), F.lit(False)
                    for h, x in rest:
                        best, any_ = F.greatest(best, F.when(h, x).otherwise(0.0)), any_ | h
                    return exact[0] | any_, F.when(exact[0], exact[1]).when(any_, best).otherwise(0.0)
                score = F.greatest(score, F.when(has, s).otherwise(0.0))
                matched = matched | has
            return matched, score
        else:
            hit = None
        score, any_ = F.lit(0.0), F.lit(False)
        for term in node.terms:
            if own.df.get(term, 0) == 0:
                continue
            has, s = one(term)
            score, any_ = score + F.when(has, s).otherwise(0.0), any_ | has
        hit = any_ if hit is None else hit
        return hit, F.when(hit, score).otherwise(0.0)
    if isinstance(node, BoostNode):
        matched, score = compiled(node.children[0], source, statistics, config)
        return matched, score * F.lit(node.factor)
    assert isinstance(node, BoolNode)
    parts = [compiled(c, source, statistics, config) for c in node.children]
    matched, score = F.lit(True), F.lit(0.0)
    for m, s in parts[: node.required]:
        matched, score = matched & m, score + s
    hits = F.lit(0)
    for m, s in parts[node.required :]:
        hits, score = hits + m.cast("int"), score + F.when(m, s).otherwise(0.0)
    if node.threshold:
        matched = matched & (hits >= node.threshold)
    return matched, F.when(matched, score).otherwise(0.0)


def edits(term: str) -> int:
    return auto_edits(term)
