"""Typed fields of a document collection.

A schema is fixed when it is built: by hand, from a ``StructType``, or from a dataclass with
``Annotated`` members. Unknown names fail with the known ones and a suggestion.
"""

from __future__ import annotations

import dataclasses
import typing
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import InvalidArgument, SchemaError
from .functions.analysis import Analyzer, SimpleAnalyzer


class IndexType(Enum):
    EQUALITY = "equality"
    RANGE = "range"
    PREFIX = "prefix"
    TEXT = "text"


@dataclass(frozen=True, eq=False)
class Field:
    """A named, typed member of a document. Fields are told apart by identity, not by name.

    ``order`` gives an enumeration's declaration order, by which its ranges go; ``expression`` may compute the value
    from other columns.
    """

    name: str
    type: T.DataType = field(default_factory=T.StringType)
    order: tuple[str, ...] | None = None
    expression: typing.Callable[[], Column] | None = None

    @property
    def column(self) -> Column:
        return self.expression() if self.expression else F.col(f"`{self.name}`")

    def value_of(self, row: T.Row) -> object:
        return row[self.name]


@dataclass(frozen=True, eq=False)
class TextField(Field):
    """A string field bound to an analyzer."""

    analyzer: Analyzer = field(default_factory=SimpleAnalyzer)


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and substitutions (for suggestions only)."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def suggestion(name: str, known: Sequence[str]) -> str | None:
    """The nearest known name, ignoring case, if it is near enough for the name's length."""
    most = 1 if len(name) <= 4 else max(2, len(name) // 3)
    best = min(((edit_distance(name.lower(), k.lower()), k) for k in known), default=(most + 1, ""))
    return best[1] if best[0] <= most else None


class SearchSchema:
    """An id field and the other fields in order."""

    def __init__(self, id_field: Field, fields: Sequence[Field] = (), indexes: dict[str, Sequence[IndexType]] | None = None):
        every = [id_field, *(f for f in fields if f is not id_field)]
        names = [f.name for f in every]
        if len(set(names)) < len(names):
            raise SchemaError(f"a field name is there twice: {sorted(n for n in set(names) if names.count(n) > 1)}")
        self.id_field = id_field
        self.fields = {f.name: f for f in every}
        self.indexes = {n: tuple(k) for n, k in (indexes or {}).items()}
        for n in self.indexes:
            self.field(n)

    def field(self, name: str) -> Field:
        if name not in self.fields:
            near = suggestion(name, list(self.fields))
            raise InvalidArgument(f"no field {name!r}; there are {', '.join(self.fields)}" + (f"; did you mean {near!r}?" if near else ""))
        return self.fields[name]

    def text_field(self, name: str) -> TextField:
        f = self.field(name)
        if not isinstance(f, TextField):
            raise InvalidArgument(f"{name!r} is no text field")
        return f

    def check(self, f: Field) -> Field:
        """The field itself, if it is this schema's own object."""
        if self.fields.get(f.name) is not f:
            raise InvalidArgument(f"field {f.name!r} is not this schema's own")
        return f

    @property
    def text_fields(self) -> list[TextField]:
        return [f for f in self.fields.values() if isinstance(f, TextField)]

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type, f is not self.id_field) for f in self.fields.values() if f.expression is None])

    @classmethod
    def from_struct(cls, struct: T.StructType, id_field: str, text: Sequence[str] = (), analyzer: Analyzer | None = None, indexes: dict[str, Sequence[IndexType]] | None = None) -> SearchSchema:
        own: list[Field] = [TextField(s.name, s.dataType, analyzer=analyzer or SimpleAnalyzer()) if s.name in text else Field(s.name, s.dataType) for s in struct.fields]
        for name in (id_field, *text):
            if name not in struct.names:
                near = suggestion(name, struct.names)
                raise InvalidArgument(f"no column {name!r}" + (f"; did you mean {near!r}?" if near else ""))
        return cls(next(f for f in own if f.name == id_field), own, indexes)

    @classmethod
    def from_frame(cls, df: DataFrame, id_field: str, text: Sequence[str] = (), **more) -> SearchSchema:
        return cls.from_struct(df.schema, id_field, text, **more)

    @classmethod
    def from_dataclass(cls, kind: type) -> SearchSchema:
        """From a dataclass: ``Annotated[T, SearchId()]`` marks the id, ``SearchText()`` a text field and
        ``SearchIndex(...)`` its indexes. All members are fields."""
        if not dataclasses.is_dataclass(kind):
            raise SchemaError(f"{kind.__name__} is no dataclass")
        hints, ids, own, indexes = typing.get_type_hints(kind, include_extras=True), [], [], {}
        for member in dataclasses.fields(kind):
            base, notes = hints[member.name], ()
            if typing.get_origin(base) is typing.Annotated:
                base, *notes = typing.get_args(base)
            spark_type, order = _spark_type(base, member.name)
            text = next((n for n in notes if isinstance(n, SearchText)), None)
            if text and not isinstance(spark_type, T.StringType):
                raise SchemaError(f"text field {member.name!r} is no string")
            f = TextField(member.name, spark_type, analyzer=text.analyzer) if text else Field(member.name, spark_type, order)
            own.append(f)
            ids += [f] if any(isinstance(n, SearchId) for n in notes) else []
            wanted = [k for n in notes if isinstance(n, SearchIndex) for k in n.kinds]
            if IndexType.PREFIX in wanted and not isinstance(spark_type, T.StringType):
                raise SchemaError(f"a prefix index needs a string: {member.name!r}")
            if len(set(wanted)) < len(wanted):
                raise SchemaError(f"an index of {member.name!r} is there twice")
            if wanted:
                indexes[member.name] = wanted
        if len(ids) != 1:
            raise SchemaError(f"{kind.__name__} has {len(ids)} id members; one is needed")
        return cls(ids[0], own, indexes)


@dataclass(frozen=True)
class SearchId:
    pass


@dataclass(frozen=True)
class SearchText:
    analyzer: Analyzer = field(default_factory=SimpleAnalyzer)


class SearchIndex:
    def __init__(self, *kinds: IndexType):
        self.kinds = kinds


_TYPES: dict[type, T.DataType] = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bytes: T.BinaryType(), datetime: T.TimestampType(), date: T.DateType(), Decimal: T.DecimalType(38, 9)}


def _spark_type(hint: object, name: str) -> tuple[T.DataType, tuple[str, ...] | None]:
    args = [a for a in typing.get_args(hint) if a is not type(None)]
    if args and len(args) == 1 and typing.get_origin(hint) is not list:
        hint = args[0]
    if isinstance(hint, type) and issubclass(hint, Enum):
        return T.StringType(), tuple(e.name for e in hint)
    if hint not in _TYPES:
        raise SchemaError(f"no type for member {name!r}: {hint}")
    return _TYPES[hint], None
