"""BM25 with a fixed order of operations, so that scores are equal to the last bit on every path."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidArgument


@dataclass(frozen=True)
class Bm25Config:
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self) -> None:
        if not (math.isfinite(self.k1) and self.k1 >= 0):
            raise InvalidArgument(f"k1 is {self.k1}")
        if not 0 <= self.b <= 1:
            raise InvalidArgument(f"b is {self.b}")


@dataclass(frozen=True)
class FieldStats:
    """Documents with a token in the field, and their tokens."""

    documents: int
    total_length: int

    @property
    def average(self) -> float:
        return self.total_length / self.documents if self.documents else 0.0


def idf(stats: FieldStats, df: int) -> float:
    return math.log1p((stats.documents - df + 0.5) / (df + 0.5))


def term_score(tf: Column, length: Column, weight: float, stats: FieldStats, config: Bm25Config) -> Column:
    """The contribution of a term of idf ``weight`` that occurs ``tf`` times."""
    norm = F.lit(config.k1) * (F.lit(1.0 - config.b) + F.lit(config.b) * length.cast("double") / F.lit(stats.average))
    return (F.lit(weight) * (tf.cast("double") * F.lit(config.k1 + 1.0))) / (tf.cast("double") + norm)


def term_score_of(tf: int, length: int, weight: float, stats: FieldStats, config: Bm25Config) -> float:
    """The same for numbers."""
    norm = config.k1 * (1.0 - config.b + config.b * length / stats.average)
    return (weight * (tf * (config.k1 + 1.0))) / (tf + norm)
