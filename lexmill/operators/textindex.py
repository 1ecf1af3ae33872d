"""Tokens, postings, lengths and corpus statistics of a text field, as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analysis import contains, word_count
from ..functions.bm25 import FieldStats
from ..plans.ranked import Statistics
from ..schema import TextField

ORD = "doc_ord"
#: Tokens that a Python task groups at a time, about.
TOKENS = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """Texts of a table with fewer files than there are cores, dealt to all of these: a file may be one group of rows, which one task reads."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df._jdf.inputFiles())  # counted in the JVM: their names stay there
    return df.repartition(cores) if 0 < files < cores else df


def _terms(f: TextField, text: Column) -> Column:
    """Array of a text's terms, in their order."""
    return f.analyzer.terms_column(text) if f.analyzer.by_pattern else F.transform(f.analyzer.column(text), lambda t: t["term"])


def _length(f: TextField, text: Column) -> Column:
    return word_count(f.analyzer.clean(text)) if f.analyzer.by_pattern else F.size(f.analyzer.column(text))


def tokens(df: DataFrame, f: TextField, ord_column: str = ORD) -> DataFrame:
    """(doc_ord, tokens array<struct<term, pos>>)"""
    own = spread(df.select(F.col(ord_column).alias(ORD), f.column.alias("_x")))
    return own.select(ORD, f.analyzer.column(F.col("_x")).alias("tokens"))


def postings(df: DataFrame, f: TextField, ord_column: str = ORD) -> DataFrame:
    """(term, doc_ord, tf, positions, dl), a row per term of a document. Tokens are grouped per document where they are: nothing is
    shuffled, and no occurrence becomes a row."""
    if f.analyzer.by_pattern:
        own = spread(df.select(F.col(ord_column).alias(ORD), f.column.alias("_x"))).select(ORD, f.analyzer.terms_column(F.col("_x")).alias("terms"))
    else:
        own = tokens(df, f, ord_column).select(ORD, F.transform("tokens", lambda t: t["term"]).alias("terms"), F.transform("tokens", lambda t: t["pos"]).alias("places"))
    kind = T.StructType([T.StructField("term", T.StringType()), own.schema[ORD], *T.StructType.fromDDL("tf int, positions array<int>, dl int").fields])
    return own.where(F.size("terms") > 0).mapInArrow(_grouped, kind)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        sizes = np.diff(whole.column("terms").offsets.to_numpy())
        part = np.cumsum(sizes, dtype=np.int64) // TOKENS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), whole.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b > a:
                yield _postings_of(whole.slice(a, b - a))


def _postings_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    lists = batch.column("terms")
    off = lists.offsets.to_numpy().astype(np.int64)
    size = np.diff(off)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(size)), size)
    if "places" in batch.schema.names:
        at = batch.column("places").flatten().to_numpy(zero_copy_only=False)
    else:
        at = np.arange(len(code)) - np.repeat(off[:-1] - off[0], size)
    key = doc * max(1, len(coded.dictionary)) + code
    order = np.lexsort((at, key))
    first = np.ones(len(order), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    starts = np.flatnonzero(first)
    tf = np.diff(np.append(starts, len(order)))
    row = doc[order[starts]]
    places = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(at[order].astype(np.int32)))
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[order[starts]])).cast(pa.string()), batch.column(ORD).take(pa.array(row)), pa.array(tf.astype(np.int32)), places, pa.array(size[row].astype(np.int32))], names=["term", ORD, "tf", "positions", "dl"])


def doc_lengths(df: DataFrame, f: TextField, ord_column: str = ORD, *more: Column) -> DataFrame:
    """(doc_ord, dl, ...) of documents with a token."""
    own = spread(df.select(F.col(ord_column).alias(ORD), f.column.alias("_x"), *more))
    return own.select(ORD, F.explode(F.array(_length(f, F.col("_x")))).alias("dl"), *[c for c in own.columns if c not in (ORD, "_x")]).where("dl > 0")


def doc_freq(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(df: DataFrame, f: TextField) -> DataFrame:
    """One row (n_docs, total_length, avgdl): documents with a token, and their tokens."""
    dl = spread(df.select(f.column.alias("_x"))).select(F.explode(F.array(_length(f, F.col("_x")).cast("long"))).alias("dl"))
    return dl.agg(F.count(F.when(F.col("dl") > 0, 1)).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_length")).withColumn("avgdl", F.coalesce(F.try_divide("total_length", "n_docs"), F.lit(0.0)))


def statistics(df: DataFrame, wanted: dict[TextField, list[str]]) -> dict[TextField, Statistics]:
    """Statistics of all fields and terms in one pass over the whole corpus: a partial and a final aggregate of one row."""
    if not wanted:
        return {}
    clean = [(f.analyzer.clean(f.column) if f.analyzer.by_pattern else _terms(f, f.column)).alias(f"_t{i}") for i, f in enumerate(wanted)]
    columns: list[Column] = []
    for i, (f, terms) in enumerate(wanted.items()):
        own = F.col(f"_t{i}")
        length = word_count(own) if f.analyzer.by_pattern else F.size(own)
        columns += [F.count(F.when(length > 0, 1)).alias(f"n{i}"), F.coalesce(F.sum(length.cast("long")), F.lit(0)).alias(f"s{i}")]
        columns += [F.count(F.when(contains(own, t) if f.analyzer.by_pattern else F.array_contains(own, t), 1)).alias(f"d{i}_{k}") for k, t in enumerate(terms)]
    row = df.select(*clean).agg(*columns).first()
    return {f: Statistics(FieldStats(row[f"n{i}"], row[f"s{i}"]), {t: row[f"d{i}_{k}"] for k, t in enumerate(terms)}) for i, (f, terms) in enumerate(wanted.items())}


def vocabulary(df: DataFrame, f: TextField, lengths: tuple[int, int] | None = None) -> DataFrame:
    """Distinct terms of the field, or those whose number of code points is in a range."""
    own = spread(df.select(f.column.alias("_x")))
    if lengths and f.analyzer.by_pattern:
        edge = r"[\p{L}\p{Nd}]"
        terms = F.regexp_extract_all(f.analyzer.clean(F.col("_x")), F.lit(rf"(?<!{edge})({edge}{{{max(1, lengths[0])},{lengths[1]}}})(?!{edge})"), F.lit(1))
    else:
        terms = _terms(f, F.col("_x"))
    found = own.select(F.explode(F.array_distinct(terms)).alias("term"))
    return (found.where(F.length("term").between(*lengths)) if lengths else found).distinct()
