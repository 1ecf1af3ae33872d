"""How a store's rows are written: field by field, or by a user's own codec as one payload beside the id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAYLOAD = "payload"


@dataclass(frozen=True)
class Codec:
    """``encode`` makes a payload of ``type`` from a struct of all fields, ``decode`` the struct from it, given its type. Both are Columns, so that rows
    stay in Spark; equal documents must have equal payloads, and every document must come back as it was. A store remembers the name."""

    name: str
    type: T.DataType
    encode: Callable[[Column], Column]
    decode: Callable[[Column, T.StructType], Column]

    def written(self, df: DataFrame, fields: T.StructType, id_name: str) -> DataFrame:
        others = [c for c in df.columns if c not in fields.names]
        return df.select(*others, id_name, self.encode(F.struct(*[F.col(f"`{c}`") for c in fields.names])).alias(PAYLOAD))

    def read(self, df: DataFrame, fields: T.StructType, id_name: str) -> DataFrame:
        others = [c for c in df.columns if c not in (PAYLOAD, id_name)]
        own = df.select(*others, self.decode(F.col(PAYLOAD), fields).alias("_document"))
        return own.select(*others, *[F.col("_document").getField(c).alias(c) for c in fields.names])

    def stored(self, schema: T.StructType, fields: T.StructType, id_name: str) -> T.StructType:
        """The columns that are written for those of ``schema``."""
        return T.StructType([*[f for f in schema.fields if f.name not in fields.names], fields[id_name], T.StructField(PAYLOAD, self.type)])


class Columns(Codec):
    """Parquet's own types, a column for each field."""

    def __init__(self) -> None:
        super().__init__("columns", T.NullType(), lambda c: c, lambda c, _: c)

    def written(self, df: DataFrame, fields: T.StructType, id_name: str) -> DataFrame:
        return df

    def read(self, df: DataFrame, fields: T.StructType, id_name: str) -> DataFrame:
        return df

    def stored(self, schema: T.StructType, fields: T.StructType, id_name: str) -> T.StructType:
        return schema


def json_codec() -> Codec:
    """Documents as JSON. Nulls are left out, numbers that aren't finite don't come back."""
    return Codec("json", T.StringType(), lambda c: F.to_json(c), lambda c, kind: F.from_json(c, kind))
