"""Index definitions, their registry and the derived tables they stand for.

Spark finds rows by the layout of files: an equality, range or prefix index is the collection's column
sorted by range into files, whose statistics let a scan skip row groups; a text index is the postings sorted by term. A
custom index gives a condition that is exact or a superset. Results never depend on indexes: the query's own
condition is always checked again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import IndexLifecycleError, InvalidArgument
from ..plans.predicates import And, Between, Equal, Prefix, Query, Terms
from ..schema import Field, IndexType, TextField
from ..sources.files import settled
from . import textindex


class Accuracy(Enum):
    EXACT = "exact"
    SUPERSET = "superset"


class PlanningMode(Enum):
    """Whether searches by conditions read an index: where its estimate promises less work than a scan, wherever there is one, or never.
    Results are the same in all."""

    COST_AWARE = "cost_aware"
    FORCE_INDEX = "force_index"
    FORCE_SCAN = "force_scan"


#: What a row found by an index costs, in rows of a scan in natural order: it is sorted back into that order.
INDEX_COST = 4
#: Blocks of rows that an index's summary has at most, which the driver may hold.
BLOCKS = 10_000


@dataclass(frozen=True)
class CandidateEstimate:
    """How many documents a condition's index would give, between which bounds, and from how many keys (or blocks of keys)."""

    cardinality: int
    sources: int
    least: int
    most: int

    @property
    def exact(self) -> bool:
        return self.least == self.most


@dataclass(frozen=True)
class AccessPath:
    """An index that serves a condition, or one of a conjunction's: its name and table, and what it is expected to give."""

    name: str
    path: str
    condition: Query
    estimate: CandidateEstimate


@dataclass(frozen=True)
class IndexDefinition:
    field: Field
    kind: IndexType | str
    #: For a custom index: from a query the candidates' condition, or None where it has no answer.
    candidates: Callable[[Query], tuple[Column, Accuracy] | None] | None = None

    @property
    def name(self) -> str:
        return f"{self.field.name}:{self.kind.value if isinstance(self.kind, IndexType) else self.kind}"


@dataclass(frozen=True)
class IndexStatistics:
    name: str
    distinct_keys: int
    indexed_documents: int


class IndexRegistry:
    """At most one index of a kind per field."""

    def __init__(self) -> None:
        self.by_name: dict[str, IndexDefinition] = {}
        self.paths: dict[str, str] = {}
        #: Ids (a column ``_key``) that changed since an index's table was built; none: it is up to date.
        self.touched: dict[str, DataFrame] = {}
        self.summaries: dict[str, list[tuple]] = {}

    def summary(self, spark: SparkSession, name: str) -> list[tuple]:
        """(low, high, rows, keys) of each block of a structured index's table; those of rows without a value have no bounds."""
        path = self.paths[name]
        if path not in self.summaries:
            self.summaries[path] = [tuple(r) for r in spark.read.parquet(f"{path}/summary").collect()]  # BLOCKS rows and one
        return self.summaries[path]

    def add(self, d: IndexDefinition, path: str | None = None, touched: DataFrame | None = None) -> None:
        if d.name in self.by_name:
            raise IndexLifecycleError(d.name, IndexLifecycleError.Reason.ALREADY_EXISTS)
        if d.kind is IndexType.TEXT and not isinstance(d.field, TextField):
            raise InvalidArgument(f"{d.field.name!r} is no text field")
        self.by_name[d.name] = d
        if path:
            self.paths[d.name] = path
        if touched is not None:
            self.touched[d.name] = touched

    def drop(self, field_name: str) -> list[str]:
        gone = [n for n, d in self.by_name.items() if d.field.name == field_name]
        for n in gone:
            self.by_name.pop(n)
            self.paths.pop(n, None)
            self.touched.pop(n, None)
        return gone

    def has(self, f: Field, kind: IndexType) -> bool:
        return f"{f.name}:{kind.value}" in self.by_name

    def path(self, f: Field, kind: IndexType) -> str | None:
        return self.paths.get(f"{f.name}:{kind.value}")


def build(df: DataFrame, d: IndexDefinition, path: str, key: Column | None = None) -> None:
    """Write the derived table of an index; ``key`` is the id, by which later changes are told."""
    if d.kind is IndexType.TEXT:
        textindex.doc_lengths(df, d.field, textindex.ORD, *([] if key is None else [key.alias("_key")])).write.parquet(f"{path}/lengths")  # type: ignore[arg-type]
        # Settled before it is sorted: a sort by range samples its input first, which would read all texts twice.
        _write_postings(settled(textindex.postings(df, d.field)), path)  # type: ignore[arg-type]
        _write_stats(df.sparkSession, path)
    else:
        _write_sorted(df, d, path)


def merge(old: str, df: DataFrame, changed: DataFrame, d: IndexDefinition, path: str, key: Column) -> None:
    """Write the derived table of ``df`` from an older one and the ids (``_key``) that changed since: no more than their documents are analysed."""
    spark = df.sparkSession
    now = df.join(changed, key == F.col("_key"), "left_semi")
    if d.kind is IndexType.TEXT:
        lengths = spark.read.parquet(f"{old}/lengths")
        gone = lengths.join(changed, "_key", "left_semi").select(textindex.ORD)
        new = textindex.doc_lengths(now, d.field, textindex.ORD, key.alias("_key"))  # type: ignore[arg-type]
        lengths.join(changed, "_key", "left_anti").unionByName(new).write.parquet(f"{path}/lengths")
        kept = spark.read.parquet(f"{old}/postings").join(gone, textindex.ORD, "left_anti")
        _write_postings(kept.unionByName(settled(textindex.postings(now, d.field))), path)  # type: ignore[arg-type]
        _write_stats(spark, path)
    else:
        kept = spark.read.parquet(f"{old}/sorted").join(changed, key == F.col("_key"), "left_anti")
        _write_sorted(kept.select(*df.columns).unionByName(now), d, path, df.where(d.field.column.isNull()).count())


def _write_sorted(df: DataFrame, d: IndexDefinition, path: str, without: int | None = None) -> None:
    """The rows that have a value, sorted by range, and a summary: a row for each key, or for each file where keys are many."""
    df.where(d.field.column.isNotNull()).repartitionByRange(d.field.column, F.col(textindex.ORD)).sortWithinPartitions(d.field.column).write.parquet(f"{path}/sorted")
    without = df.where(d.field.column.isNull()).count() if without is None else without
    keys = df.sparkSession.read.parquet(f"{path}/sorted").select(d.field.column.alias("key"), F.input_file_name().alias("file"))
    few = keys.agg(F.approx_count_distinct("key")).first()[0] <= BLOCKS // 2
    blocks = keys.groupBy("key" if few else "file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("rows"), F.approx_count_distinct("key").alias("keys"))
    none = keys.sparkSession.range(1).select(F.lit(None).cast(keys.schema["key"].dataType).alias("low"), F.lit(None).cast(keys.schema["key"].dataType).alias("high"), F.lit(without).cast("long").alias("rows"), F.lit(0).cast("long").alias("keys"))
    blocks.select("low", "high", "rows", "keys").unionByName(none).coalesce(1).write.parquet(f"{path}/summary")


def _write_postings(posted: DataFrame, path: str) -> None:
    posted.repartitionByRange("term", textindex.ORD).sortWithinPartitions("term", textindex.ORD).write.parquet(f"{path}/postings")


def _write_stats(spark: SparkSession, path: str) -> None:
    """The terms with their document frequencies, and the corpus's one row, from what is written."""
    textindex.doc_freq(spark.read.parquet(f"{path}/postings").select("term")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    spark.read.parquet(f"{path}/lengths").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.col("dl").cast("long")), F.lit(0)).alias("total_length")).coalesce(1).write.parquet(f"{path}/stats")


def statistics(df: DataFrame, d: IndexDefinition) -> IndexStatistics:
    if isinstance(d.field, TextField) and d.kind is IndexType.TEXT:
        row = df.select(F.explode(F.array_distinct(F.transform(d.field.analyzer.column(d.field.column), lambda t: t["term"]))).alias("term"), textindex.ORD).agg(F.count_distinct("term"), F.count_distinct(textindex.ORD)).first()
    else:
        row = df.agg(F.count_distinct(d.field.column), F.count(d.field.column)).first()
    return IndexStatistics(d.name, row[0], row[1])


def _order(f: Field) -> Callable[[object], object]:
    return (lambda v: f.order.index(v)) if f.order is not None else (lambda v: v)  # type: ignore[union-attr]


def _summed(blocks: list[tuple], whole: Callable[[object, object], bool], part: Callable[[object, object], bool]) -> CandidateEstimate:
    """The blocks that lie wholly in a range, and half of each that may in part."""
    sure = [b for b in blocks if whole(b[0], b[1])]
    maybe = [b for b in blocks if not whole(b[0], b[1]) and part(b[0], b[1])]
    least, more = sum(b[2] for b in sure), sum(b[2] for b in maybe)
    return CandidateEstimate(least + more // 2, len(sure) + len(maybe), least, least + more)


def estimate(query: Query, registry: IndexRegistry, spark: SparkSession) -> AccessPath | None:
    """The index of one condition (an equality, a range, a prefix, terms), and what it would give; None where no index answers it. A null is in no
    index."""
    if isinstance(query, Terms):
        path = registry.path(query.field, IndexType.TEXT)
        if path is None or not query.terms:
            return None
        df = {r[0]: r[1] for r in spark.read.parquet(f"{path}/terms").where(F.col("term").isin(list(query.terms))).collect()}
        found = [df.get(t, 0) for t in query.terms]
        least, most = (0 if len(found) > 1 else found[0], min(found)) if query.every else (max(found), sum(found))
        return AccessPath(f"{query.field.name}:{IndexType.TEXT.value}", path, query, CandidateEstimate(min(most, sum(found)), len(found), least, most))
    kinds = {Equal: (IndexType.EQUALITY, IndexType.RANGE, IndexType.PREFIX), Between: (IndexType.RANGE,), Prefix: (IndexType.PREFIX,)}.get(type(query), ())
    if isinstance(query, Equal) and query.value is None:
        return None
    for kind in kinds:
        if path := registry.path(query.field, kind):  # type: ignore[attr-defined]
            f, name = query.field, f"{query.field.name}:{kind.value}"  # type: ignore[attr-defined]
            at = _order(f)
            blocks = [b for b in registry.summary(spark, name) if b[0] is not None]
            if f.order is not None and any(b[0] != b[1] for b in blocks):
                continue
            if isinstance(query, Equal):
                found = _summed(blocks, lambda x, y: x == y == query.value, lambda x, y: x != y and at(x) <= at(query.value) <= at(y))
                if not found.exact:  # one key of those of its block
                    share = sum(b[2] // max(1, b[3]) for b in blocks if b[0] != b[1] and at(b[0]) <= at(query.value) <= at(b[1]))
                    found = CandidateEstimate(found.least + share, found.sources, found.least, found.most)
            elif isinstance(query, Between):
                low, high = at(query.low), at(query.high)
                found = _summed(blocks, lambda x, y: low <= at(x) and at(y) <= high, lambda x, y: at(x) <= high and low <= at(y))
            else:
                assert isinstance(query, Prefix)
                p = query.prefix
                found = _summed(blocks, lambda x, y: x.startswith(p) and y.startswith(p), lambda x, y: x[: len(p)] <= p <= y[: len(p)])
            return AccessPath(name, path, query, found)
    return None


def access_path(query: Query, registry: IndexRegistry, spark: SparkSession, mode: PlanningMode) -> AccessPath | None:
    """The index that a search reads: of the conditions of a conjunction that which promises the fewest rows; with ``COST_AWARE`` only if
    these, at their cost, are fewer than a scan's. The other conditions are checked on what it gives."""
    if mode is PlanningMode.FORCE_SCAN:
        return None
    every = [e for q in (query.children if isinstance(query, And) else (query,)) if (e := estimate(q, registry, spark))]
    if not every:
        return None
    best = min(every, key=lambda e: (e.estimate.cardinality, e.estimate.sources))
    if mode is PlanningMode.FORCE_INDEX:
        return best
    if isinstance(best.condition, Terms):
        total = spark.read.parquet(f"{best.path}/stats").first()["n_docs"]
    else:
        total = sum(b[2] for b in registry.summary(spark, best.name))
    return best if INDEX_COST * best.estimate.cardinality <= total else None


def read_postings(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """Postings of the terms; the filter is pushed to the files, which are sorted by term."""
    return spark.read.parquet(f"{path}/postings").where(F.col("term").isin(terms))
