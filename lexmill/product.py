"""A ready-made product collection, and the older filter helpers over it."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .engine import SearchEngine
from .errors import InvalidArgument
from .plans import predicates as q
from .schema import Field, IndexType, SearchSchema

CATEGORIES = ("ELECTRONICS", "BOOKS", "CLOTHING", "HOME", "BEAUTY")


def product_schema() -> SearchSchema:
    fields = [Field("id"), Field("name"), Field("category", order=CATEGORIES), Field("price", T.DoubleType()), Field("prime", T.BooleanType()), Field("rating", T.DoubleType())]
    return SearchSchema(fields[0], fields, {"name": [IndexType.PREFIX], "category": [IndexType.EQUALITY], "prime": [IndexType.EQUALITY], "price": [IndexType.RANGE]})


def product_engine(spark: SparkSession, path: str | None = None) -> SearchEngine:
    """An engine of products, with the schema's indexes."""
    return SearchEngine(spark, product_schema(), path)


class ProductFilters:
    """Each method gives a condition on a schema with the product fields."""

    def __init__(self, schema: SearchSchema):
        self.schema = schema

    def category(self, name: str) -> q.Query:
        return q.eq(self.schema.field("category"), name)

    def name(self, start: str) -> q.Query:
        return q.prefix(self.schema.field("name"), start)

    def price_range(self, low: float, high: float) -> q.Query:
        return q.between(self.schema.field("price"), float(low), float(high))

    def prime(self, value: bool = True) -> q.Query:
        return q.eq(self.schema.field("prime"), value)

    def rating(self, low: float, high: float = float("inf")) -> q.Query:
        if low != low or high != high:
            raise InvalidArgument("a rating is a number")
        return q.between(self.schema.field("rating"), float(low), float(high))

    and_ = staticmethod(q.and_)
    or_ = staticmethod(q.or_)
    not_ = staticmethod(q.not_)
