"""Expansion of a term to the vocabulary's terms within its edits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.osa import auto_edits, osa_distance


def lengths(term: str) -> tuple[int, int]:
    """Of the terms that may be within the term's edits."""
    return len(term) - auto_edits(term), len(term) + auto_edits(term)


def expansions(vocabulary: DataFrame, term: str) -> DataFrame:
    """(term, distance) of ``vocabulary (term)`` within the term's edits, nearest first, then by code points.

    Lengths and Spark's own Levenshtein distance (never over twice the edits) leave few terms for the exact distance.
    """
    most = auto_edits(term)

    @F.pandas_udf("int")
    def exact(terms: pd.Series) -> pd.Series:
        return terms.map(lambda t: osa_distance(term, t, most)).astype("int32")

    if most == 0:
        return vocabulary.where(F.col("term") == term).select("term", F.lit(0).alias("distance")).limit(1)
    near = vocabulary.where(F.length("term").between(len(term) - most, len(term) + most)).where(F.levenshtein(F.col("term"), F.lit(term), 2 * most) >= 0)
    found = near.withColumn("distance", exact("term")).where(F.col("distance") <= most)
    return found.select("term", "distance").orderBy("distance", "term")


def expand(vocabulary: DataFrame, term: str) -> list[tuple[str, int]]:
    """On the driver, for the query's plan. What is collected is what ``term`` can be misspelt as, not the vocabulary."""
    return [(r[0], r[1]) for r in expansions(vocabulary, term).collect()]
