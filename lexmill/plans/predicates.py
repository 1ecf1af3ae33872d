"""Structured predicates: a tree of conditions that compiles to one boolean Column.

Logic is two-valued: every leaf is true or false, for nulls too, and so is every combination.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgument
from ..functions.analysis import contains
from ..schema import Field, SearchSchema, TextField


class Query:
    """Base of all conditions. ``column`` is never null."""

    def column(self) -> Column:
        raise NotImplementedError

    def fields(self) -> list[Field]:
        return []

    def check(self, schema: SearchSchema) -> None:
        for f in self.fields():
            schema.check(f)

    def __and__(self, other: Query) -> Query:
        return And((self, other))

    def __or__(self, other: Query) -> Query:
        return Or((self, other))

    def __invert__(self) -> Query:
        return Not(self)


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _is_zero(value: object) -> bool:
    return isinstance(value, float) and value == 0.0


def _zero(f: Field, minus: bool) -> Column:
    """Whether a value is the zero of that sign. No equality here: the optimizer would put its constant in the cast's place."""
    zero = (f.column >= 0.0) & (f.column <= 0.0)
    return _sure(zero & (f.column.cast("string").startswith("-") == F.lit(minus)))


@dataclass(frozen=True)
class Equal(Query):
    field: Field
    value: object

    def column(self) -> Column:
        if _is_zero(self.value):  # -0.0 and 0.0 are different values
            return _zero(self.field, math.copysign(1.0, self.value) < 0)  # type: ignore[arg-type]
        return self.field.column.eqNullSafe(F.lit(self.value))

    def fields(self) -> list[Field]:
        return [self.field]


def _utf16(c: Column) -> Column:
    return F.encode(c, "UTF-16BE")


@dataclass(frozen=True)
class Between(Query):
    """Inclusive at both ends; null is in no range; a reversed range is empty.

    Strings go by UTF-16 units. That order differs from Spark's, by code points, only between
    U+E000..U+FFFF and characters beyond; where no bound has either, Spark's own comparison is used and pushed down.
    """

    field: Field
    low: object
    high: object

    def __post_init__(self) -> None:
        if self.low is None or self.high is None:
            raise InvalidArgument("a range needs both bounds")

    def column(self) -> Column:
        c, low, high = self.field.column, self.low, self.high
        if self.field.order is not None:
            order = F.array(*[F.lit(x) for x in self.field.order])
            at = {x: i + 1 for i, x in enumerate(self.field.order)}
            if low not in at or high not in at:
                raise InvalidArgument(f"{self.field.name!r} has no such value")
            return _sure((c.isNotNull()) & F.array_position(order, c).between(at[low], at[high]))
        if isinstance(low, str) and any(ch > "퟿" for ch in f"{low}{high}"):
            return _sure((_utf16(c) >= _utf16(F.lit(low))) & (_utf16(c) <= _utf16(F.lit(high))))
        inside = c.isNotNull() & (c >= F.lit(low)) & (c <= F.lit(high))  # never null, and pushed to the scan
        if _is_zero(low) and math.copysign(1.0, low) > 0:  # type: ignore[arg-type]
            inside = inside & ~_zero(self.field, True)
        if _is_zero(high) and math.copysign(1.0, high) < 0:  # type: ignore[arg-type]
            inside = inside & ~_zero(self.field, False)
        return inside

    def fields(self) -> list[Field]:
        return [self.field]


@dataclass(frozen=True)
class Prefix(Query):
    field: Field
    prefix: str

    def __post_init__(self) -> None:
        if not isinstance(self.field.type, T.StringType):
            raise InvalidArgument(f"{self.field.name!r} is no string")
        if self.prefix is None:
            raise InvalidArgument("a prefix is needed")

    def column(self) -> Column:
        return self.field.column.isNotNull() & self.field.column.startswith(self.prefix)

    def fields(self) -> list[Field]:
        return [self.field]


def _text_terms(f: TextField, text: str) -> tuple[str, ...]:
    if not isinstance(f, TextField):
        raise InvalidArgument(f"{f.name!r} is no text field")
    return tuple(f.analyzer.terms(text))


@dataclass(frozen=True)
class Terms(Query):
    """Any or all of the distinct terms of a text; without terms, nothing matches."""

    field: TextField
    terms: tuple[str, ...]
    every: bool

    def column(self) -> Column:
        if not self.terms:
            return F.lit(False)
        if self.field.analyzer.by_pattern:  # found in the text: no tokens are made
            found = [contains(self.field.analyzer.clean(self.field.column), t) for t in self.terms]
            out = found[0]
            for c in found[1:]:
                out = out & c if self.every else out | c
            return out
        own = F.transform(self.field.analyzer.column(self.field.column), lambda t: t["term"])
        if len(self.terms) == 1:
            return _sure(F.array_contains(own, self.terms[0]))
        wanted = F.array(*[F.lit(t) for t in self.terms])
        return _sure(F.size(F.array_except(wanted, own)) == 0) if self.every else _sure(F.arrays_overlap(own, wanted))

    def fields(self) -> list[Field]:
        return [self.field]


@dataclass(frozen=True)
class And(Query):
    children: tuple[Query, ...]

    def column(self) -> Column:
        out = F.lit(True)
        for i, c in enumerate(self.children):
            out = c.column() if i == 0 else out & c.column()
        return out

    def fields(self) -> list[Field]:
        return [f for c in self.children for f in c.fields()]


@dataclass(frozen=True)
class Or(Query):
    children: tuple[Query, ...]

    def column(self) -> Column:
        out = F.lit(False)
        for i, c in enumerate(self.children):
            out = c.column() if i == 0 else out | c.column()
        return out

    def fields(self) -> list[Field]:
        return [f for c in self.children for f in c.fields()]


@dataclass(frozen=True)
class Not(Query):
    child: Query

    def column(self) -> Column:
        return ~self.child.column()

    def fields(self) -> list[Field]:
        return self.child.fields()


@dataclass(frozen=True)
class MatchAll(Query):
    def column(self) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Custom(Query):
    """A user's own condition, as a Column (built-in functions or a UDF). Null counts as false."""

    condition: Callable[[], Column]

    def column(self) -> Column:
        return _sure(self.condition())


def has_terms(query: Query) -> bool:
    """Whether a condition looks into texts."""
    children = query.children if isinstance(query, (And, Or)) else (query.child,) if isinstance(query, Not) else ()
    return isinstance(query, Terms) or any(has_terms(c) for c in children)


def eq(field: Field, value: object) -> Query:
    return Equal(field, value)


def between(field: Field, low: object, high: object) -> Query:
    return Between(field, low, high)


def prefix(field: Field, start: str) -> Query:
    return Prefix(field, start)


def term(field: TextField, text: str) -> Query:
    terms = _text_terms(field, text)
    if len(terms) != 1:
        raise InvalidArgument(f"{text!r} has {len(terms)} distinct terms; one is needed")
    return Terms(field, terms, True)


def any_terms(field: TextField, text: str) -> Query:
    return Terms(field, _text_terms(field, text), False)


def all_terms(field: TextField, text: str) -> Query:
    return Terms(field, _text_terms(field, text), True)


def and_(*children: Query) -> Query:
    return And(tuple(children))


def or_(*children: Query) -> Query:
    return Or(tuple(children))


def not_(child: Query) -> Query:
    return Not(child)


def match_all() -> Query:
    return MatchAll()


def custom(condition: Callable[[], Column]) -> Query:
    return Custom(condition)
