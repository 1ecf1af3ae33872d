"""Execution of searches on one pinned snapshot."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidState, SearchCursorError, UnsupportedAnalyzer
from ..functions.analysis import frequency, word_count, words
from ..functions.bm25 import FieldStats
from ..plans import ranked
from ..plans.evaluate import Document, Explanation, evaluate
from ..plans.predicates import Query, Terms, has_terms
from ..plans.ranked import Node, Source, Statistics
from ..plans.requests import HighlightedSearchRequest, SearchCursor, SearchPageRequest, SearchRequest, TotalHitsMode
from ..schema import IndexType, SearchSchema, TextField
from ..sources.files import settled
from . import fuzzy, highlight, textindex
from .indexes import CandidateEstimate, IndexRegistry, PlanningMode, access_path, read_postings
from .textindex import ORD

#: Hits that are brought to the driver at most before their rows are read; scans whose findings a searcher keeps.
FETCHED, KEPT = 10_000, 8
#: Matches of a condition whose orders may be broadcast.
BROADCAST_ROWS = 200_000
FRAGMENTS = "array<struct<field:string,fragments:array<struct<start:int,end:int,text:string,spans:array<struct<start:int,end:int>>>>>>"


@dataclass
class Page:
    hits: DataFrame
    next: SearchCursor | None
    total: int | None


@dataclass
class Facts:
    """Rows (doc_ord, _passed, lengths, frequencies, positions), the corpus's statistics, and the columns by field and term."""

    rows: DataFrame
    statistics: dict[TextField, Statistics]
    place: dict[tuple[TextField, str], str]
    count: dict[tuple[TextField, str], str]
    length: dict[TextField, str]


@dataclass
class Searcher:
    """Searches of ``df``, whose rows have a ``doc_ord``, the natural order."""

    df: DataFrame
    schema: SearchSchema
    registry: IndexRegistry = field(default_factory=IndexRegistry)
    version: int = 0
    engine: str = "static"
    mode: PlanningMode = PlanningMode.COST_AWARE
    #: Whether ranked leaves need a text index on their field.
    strict: bool = False
    _expansions: dict[tuple[str, str], list[tuple[str, int]]] = field(default_factory=dict)
    #: What scans found: (terms, filter, facts), the latest last.
    _kept: list[tuple[tuple, Query | None, Facts]] = field(default_factory=list)

    @classmethod
    def over(cls, df: DataFrame, schema: SearchSchema, **more) -> Searcher:
        """A static table: the id's order is the natural order."""
        return cls(df.withColumn(ORD, schema.id_field.column), schema, **more)

    # -- structured

    def get(self, key: object) -> DataFrame:
        return self.df.where(self.schema.id_field.column == F.lit(key)).limit(1)

    def search(self, query: Query) -> DataFrame:
        """Matching rows, in natural order. A sort samples its input first; where that reads texts, matches are settled before."""
        found = self.matching(query)
        if has_terms(query):
            ords = settled(found.select(ORD))
            found = self.df.join(F.broadcast(ords) if ords.count() <= BROADCAST_ROWS else ords, ORD, "left_semi")
        return found.orderBy(ORD)

    def matching(self, query: Query) -> DataFrame:
        query.check(self.schema)
        source = self._by_index(query)
        for d in self.registry.by_name.values():
            if d.candidates is not None and (found := d.candidates(query)) is not None:
                source = source.where(F.coalesce(found[0], F.lit(False)))
        if has_terms(query):  # checked behind the dealing, where a filter would be pushed before it
            return once(textindex.spread(source), [query.column().alias("_matched")]).where("_matched").select(*self.df.columns)
        return source.where(query.column())

    def estimate(self, query: Query) -> CandidateEstimate | None:
        """What the index that answers a condition would give, as of when it was built; None without one."""
        query.check(self.schema)
        path = access_path(query, self.registry, self.df.sparkSession, PlanningMode.FORCE_INDEX)
        return path.estimate if path else None

    def _by_index(self, query: Query) -> DataFrame:
        """Candidates: the rows that an index gives, or all. The whole condition is still to be checked, but for terms that postings answer."""
        spark = self.df.sparkSession
        way = access_path(query, self.registry, spark, self.mode)
        if way is None:
            return self.df
        touched = self.registry.touched.get(way.name)
        if isinstance(way.condition, Terms):
            ords = read_postings(spark, way.path, list(way.condition.terms)).select(ORD, "term")
            if way.condition.every:
                ords = ords.groupBy(ORD).agg(F.count("*").alias("n")).where(F.col("n") == len(way.condition.terms))
            few = way.estimate.most <= BROADCAST_ROWS
            ords = ords.select(ORD).distinct()
            source = self.df.join(F.broadcast(ords) if few else ords, ORD, "left_semi").select(*self.df.columns)
        else:
            source = spark.read.parquet(f"{way.path}/sorted").select(*self.df.columns)
        if touched is not None:
            source = self._changed(source, touched, "left_anti").unionByName(self._changed(self.df, touched, "left_semi"))
        return source

    def _changed(self, df: DataFrame, touched: DataFrame, how: str) -> DataFrame:
        return df.join(touched, self.schema.id_field.column == F.col("_key"), how)

    def _touched(self, wanted: dict[TextField, list[str]]) -> DataFrame | None:
        """Ids that changed since any of the fields' postings were built."""
        own = [t for f in wanted if (t := self.registry.touched.get(f"{f.name}:{IndexType.TEXT.value}")) is not None]
        out = own[0] if own else None
        for t in own[1:]:
            out = out.unionByName(t)  # type: ignore[union-attr]
        return out.distinct() if out is not None and len(own) > 1 else out

    # -- ranked

    def _check(self, f: TextField, has_terms: bool) -> None:
        self.schema.check(f)
        if self.strict and has_terms and not self.registry.has(f, IndexType.TEXT):
            raise InvalidState(f"no text index on {f.name!r}")

    def _expand(self, f: TextField, term: str) -> list[tuple[str, int]]:
        if (f.name, term) not in self._expansions:
            path = self.registry.path(f, IndexType.TEXT)
            known = self.df.sparkSession.read.parquet(f"{path}/terms").select("term") if path else textindex.vocabulary(self.df, f, fuzzy.lengths(term))
            touched = self._touched({f: [term]}) if path else None
            if touched is not None:
                known = known.unionByName(textindex.vocabulary(self._changed(self.df, touched, "left_semi"), f, fuzzy.lengths(term))).distinct()
            self._expansions[f.name, term] = fuzzy.expand(known, term)
        return self._expansions[f.name, term]

    def normalised(self, request: SearchRequest) -> Node:
        assert request.query is not None
        if request.filter is not None:
            request.filter.check(self.schema)
        return ranked.normalise(request.query, self._expand, self._check)

    def statistics(self, node: Node, request: SearchRequest | None = None) -> dict[TextField, Statistics]:
        """Of the whole corpus, whatever a request filters: from stored postings where all fields have them."""
        wanted = ranked.needed(node)
        paths = {f: self.registry.path(f, IndexType.TEXT) for f in wanted}
        if not wanted or not all(paths.values()):
            return self._facts(node, request).statistics if wanted else {}
        spark, out, touched = self.df.sparkSession, {}, self._touched(wanted)
        later = textindex.statistics(self._changed(self.df, touched, "left_semi"), wanted) if touched is not None else {}
        for f, terms in wanted.items():
            row = spark.read.parquet(f"{paths[f]}/stats").first()
            df = {r[0]: r[1] for r in spark.read.parquet(f"{paths[f]}/terms").where(F.col("term").isin(terms)).collect()}
            n, total = row["n_docs"], row["total_length"]
            if touched is not None:  # without the old versions of what changed, and with the new ones
                old = spark.read.parquet(f"{paths[f]}/lengths").join(touched, "_key", "left_semi")
                gone = old.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
                n, total = n - gone[0] + later[f].stats.documents, total - gone[1] + later[f].stats.total_length
                posted = read_postings(spark, paths[f], terms)  # type: ignore[arg-type]
                for term, k in textindex.doc_freq(posted.join(old.select(ORD), ORD, "left_semi")).collect():
                    df[term] -= k
                for term, k in later[f].df.items():
                    df[term] = df.get(term, 0) + k
            out[f] = Statistics(FieldStats(n, total), df)
        return out

    def _facts(self, node: Node, request: SearchRequest | None) -> Facts:
        """What a scan finds in all texts for a query, kept for its statistics, scores, further pages and highlights: texts are read once."""
        condition = request.filter if request else None
        wanted = ranked.needed(node)
        key = (tuple((f.name, tuple(terms)) for f, terms in wanted.items()), tuple((x.field.name, x.slots) for x in ranked.phrases(node)))
        for known, asked, facts in self._kept:
            if known == key and (asked is condition or request is None):
                return facts
        rows, place, count, length = _found(textindex.spread(self._sources(self.df, wanted, condition)), node, wanted)
        rows = settled(rows)
        columns: list[Column] = []
        for i, (f, terms) in enumerate(wanted.items()):
            columns += [F.count(F.when(F.col(length[f]) > 0, 1)).alias(f"n{i}"), F.coalesce(F.sum(F.col(length[f]).cast("long")), F.lit(0)).alias(f"s{i}")]
            columns += [F.count(F.when(F.col(count[f, t]) > 0, 1)).alias(f"d{i}_{k}") for k, t in enumerate(terms)]
        row = rows.agg(*columns).first()
        statistics = {f: Statistics(FieldStats(row[f"n{i}"], row[f"s{i}"]), {t: row[f"d{i}_{k}"] for k, t in enumerate(terms)}) for i, (f, terms) in enumerate(wanted.items())}
        facts = Facts(rows, statistics, place, count, length)
        self._kept[:] = [*self._kept, (key, condition, facts)][-KEPT:]
        return facts

    def _sources(self, df: DataFrame, wanted: dict[TextField, list[str]], condition: Query | None) -> DataFrame:
        """Each row's order, whether it passes the filter, and the texts, by the number of their field."""
        passed = condition.column() if condition is not None else F.lit(True)
        return df.select(ORD, passed.alias("_passed"), *[f.column.alias(f"_x{i}") for i, f in enumerate(wanted)])

    def ranking(self, request: SearchRequest) -> DataFrame:
        """All matches, (doc_ord, score), in no order."""
        node = self.normalised(request)
        if ranked.is_empty(node):
            return self.df.select(ORD, F.lit(0.0).alias("score")).where(F.lit(False))
        wanted = ranked.needed(node)
        paths = {f: self.registry.path(f, IndexType.TEXT) for f in wanted}
        if self.mode is PlanningMode.FORCE_SCAN or not all(paths.values()):
            return self._ranked(self._facts(node, request), node, request)
        statistics, touched = self.statistics(node), self._touched(wanted)
        docs = self.df if touched is None else self._changed(self.df, touched, "left_anti")
        facts = self._posted(node, statistics, wanted, paths)  # type: ignore[arg-type]
        stored = self._ranked(facts, node, request)
        if request.filter is not None:
            stored = stored.join(docs.where(request.filter.column()).select(ORD), ORD, "left_semi")
        elif touched is not None:
            stored = stored.join(docs.select(ORD), ORD, "left_semi")
        if touched is None:
            return stored
        rows, place, count, length = _found(self._sources(self._changed(self.df, touched, "left_semi"), wanted, request.filter), node, wanted)
        return stored.unionByName(self._ranked(Facts(rows, statistics, place, count, length), node, request))

    def _ranked(self, facts: Facts, node: Node, request: SearchRequest) -> DataFrame:
        source = Source(lambda f, t: F.col(facts.place[f, t]), lambda f, t: F.col(facts.count[f, t]), lambda f: F.col(facts.length[f]))
        matched, score = ranked.compiled(node, source, facts.statistics, request.config)
        checked = F.when(F.isnan(score) | (score < 0) | (score == float("inf")), F.raise_error(F.lit("a score is not finite, or negative")).cast("double")).otherwise(score)
        return facts.rows.where(F.col("_passed") & matched).select(ORD, checked.alias("score"))

    def _posted(self, node: Node, statistics: dict, wanted: dict[TextField, list[str]], paths: dict[TextField, str]) -> Facts:
        """Candidates from the postings of the needed terms alone, brought together per document."""
        spark, place, count, length, rows = self.df.sparkSession, {}, {}, {}, None
        for i, (f, terms) in enumerate(wanted.items()):
            own = read_postings(spark, paths[f], terms).select(ORD, F.lit(i).alias("f"), "term", "tf", "positions", "dl")
            rows = own if rows is None else rows.unionByName(own)
        columns: list[Column] = []
        none = F.array().cast("array<int>")
        placed = {(x.field, t) for x in ranked.phrases(node) for t in x.terms}
        for i, (f, terms) in enumerate(wanted.items()):
            length[f] = f"_l{i}"
            columns.append(F.coalesce(F.max(F.when(F.col("f") == i, F.col("dl"))), F.lit(0)).alias(f"_l{i}"))
            for k, t in enumerate(terms):
                own = (F.col("f") == i) & (F.col("term") == t)
                count[f, t] = f"_n{i}_{k}"
                columns.append(F.coalesce(F.max(F.when(own, F.col("tf"))), F.lit(0)).alias(count[f, t]))
                if (f, t) in placed:
                    place[f, t] = f"_p{i}_{k}"
                    columns.append(F.coalesce(F.max(F.when(own, F.col("positions"))), none).alias(place[f, t]))
        assert rows is not None
        return Facts(rows.groupBy(ORD).agg(*columns).withColumn("_passed", F.lit(True)), statistics, place, count, length)

    def scored(self, request: SearchRequest) -> DataFrame:
        """All matching rows with their score, in no order."""
        return self.df.join(self.ranking(request), ORD).select(*self.df.columns, "score")

    def _fetched(self, best: list[T.Row]) -> DataFrame:
        """The rows of a page, given as (doc_ord, score): found by their order, which is pushed to the scan."""
        if not best:
            return self.df.withColumn("score", F.lit(0.0)).where(F.lit(False))
        scores = self.df.sparkSession.createDataFrame(best, T.StructType([T.StructField(ORD, self.df.schema[ORD].dataType), T.StructField("score", T.DoubleType())]))
        rows = self.df.where(F.col(ORD).isin([r[0] for r in best])).join(F.broadcast(scores), ORD)
        return rows.select(*self.df.columns, "score").orderBy(F.desc("score"), ORD)

    def top_k(self, request: SearchRequest) -> DataFrame:
        """The best rows: by falling score, then natural order. They are chosen before any row is read whole."""
        best = self.ranking(request).orderBy(F.desc("score"), ORD).limit(request.limit)
        if request.limit <= FETCHED:
            return self._fetched(best.collect())  # no more than the limit
        return self.df.join(best, ORD).select(*self.df.columns, "score").orderBy(F.desc("score"), ORD)

    # -- pages

    def check_cursor(self, page: SearchPageRequest) -> None:
        cursor, reason = page.after, SearchCursorError.Reason
        if cursor is None:
            return
        if not isinstance(cursor, SearchCursor):
            raise SearchCursorError("not a cursor of this library", reason.UNSUPPORTED_CURSOR)
        if cursor.engine != self.engine:
            raise SearchCursorError("it came from another engine", reason.DIFFERENT_ENGINE)
        if cursor.request != id(page.search):
            raise SearchCursorError("it came from another request", reason.DIFFERENT_REQUEST)
        if cursor.version != self.version:
            raise SearchCursorError(f"it came from version {cursor.version}; this is {self.version}", reason.STALE_SNAPSHOT)

    def page(self, page: SearchPageRequest) -> Page:
        self.check_cursor(page)
        every = self.ranking(page.search)
        total = every.count() if page.totals is TotalHitsMode.EXACT else None
        rest, limit = every, page.search.limit
        if page.after is not None:
            rest = rest.where((F.col("score") < page.after.score) | ((F.col("score") == page.after.score) & (F.col(ORD) > page.after.doc_ord)))
        rows = rest.orderBy(F.desc("score"), ORD).limit(limit + 1).collect()  # a page's rows
        hits = self._fetched(rows[:limit])
        last = rows[limit - 1] if len(rows) > limit else None
        cursor = SearchCursor(self.engine, id(page.search), self.version, last["score"], last[ORD]) if last else None
        return Page(hits, cursor, total)

    # -- explanations and highlights

    def _document(self, row: T.Row, fields: list[TextField]) -> Document:
        return Document({f: f.analyzer.checked(row[f.name], f.name) for f in fields})

    def explain(self, request: SearchRequest, key: object) -> Explanation | None:
        """Why, or why not, the document of that id matches; None where there is none."""
        node = self.normalised(request)
        row = self.get(key).first()
        if row is None:
            return None
        wanted = list(ranked.needed(node))
        own = evaluate(node, self._document(row, wanted), self.statistics(node, request), request.config)
        children = [own]
        if request.filter is not None:
            passed = not self.get(key).where(request.filter.column()).isEmpty()
            children.append(Explanation(passed, 0.0, "filter"))
        matched = all(c.matched for c in children)
        return Explanation(matched, own.score if matched else 0.0, "search", tuple(children))

    def highlight(self, request: HighlightedSearchRequest) -> DataFrame:
        """The best rows with ``highlights``: fragments of each asked field, made of the hits alone."""
        for f in request.fields:
            self.schema.check(f)
            if not f.analyzer.offsets:
                raise UnsupportedAnalyzer(f"the analyzer of {f.name!r} knows no offsets")
        node = self.normalised(request.search)
        top = self.top_k(request.search)
        statistics = {} if ranked.is_empty(node) else self.statistics(node, request.search)
        wanted, config = list(dict.fromkeys([*ranked.needed(node), *request.fields])), request.search.config
        out = []
        for row in top.collect():  # at most the request's limit
            doc = self._document(row, wanted)
            marks = []
            for f in request.fields:
                text = row[f.name] or ""
                highlight.check_offsets(doc.tokens[f], text, f.name)
                spans = highlight.evidence(node, doc, f, statistics, config)
                marks.append((f.name, [(x.start, x.end, x.text, list(x.spans)) for x in highlight.fragments(text, spans, request.context, request.max_fragments)]))
            out.append((*row, marks))
        schema = T.StructType([*top.schema.fields, T.StructField("highlights", T._parse_datatype_string(FRAGMENTS))])
        return self.df.sparkSession.createDataFrame(out, schema)


def once(df: DataFrame, columns: list[Column]) -> DataFrame:
    """``df`` with costly columns computed once per row. A condition on plain computed columns is pushed below them
    and computes them again, for each time it names them; below an explode of one element it isn't."""
    return df.select("*", F.explode(F.array(F.struct(*columns))).alias("_once")).select(*df.columns, "_once.*")


Named = dict[tuple[TextField, str], str]


def _found(df: DataFrame, node: Node, wanted: dict[TextField, list[str]]) -> tuple[DataFrame, Named, Named, dict[TextField, str]]:
    """From the texts (``_x0``, ...) each field's length, its terms' frequencies, and the positions of terms of phrases in rows that may
    hold one; with the names of these columns."""
    place: Named = {}
    count = {(f, t): f"_n{i}_{k}" for i, (f, terms) in enumerate(wanted.items()) for k, t in enumerate(terms)}
    length = {f: f"_l{i}" for i, f in enumerate(wanted)}
    keep = [ORD, "_passed"]
    patterns = [f.analyzer.by_pattern for f in wanted]
    df = once(df, [(f.analyzer.clean(F.col(f"_x{i}")) if p else f.analyzer.column(F.col(f"_x{i}"))).alias(f"_t{i}") for i, (f, p) in enumerate(zip(wanted, patterns, strict=True))])
    columns: list[Column] = []
    for i, ((f, terms), p) in enumerate(zip(wanted.items(), patterns, strict=True)):
        columns.append((word_count(F.col(f"_t{i}")) if p else F.size(f"_t{i}")).alias(length[f]))
        columns += [(frequency(F.col(f"_t{i}"), t) if p else F.size(_places(F.col(f"_t{i}"), t))).alias(count[f, t]) for t in terms]
    df = once(df.select(*keep, *[f"_t{i}" for i in range(len(wanted))]), columns)
    placed = ranked.phrases(node)
    places: list[Column] = []
    for i, ((f, terms), p) in enumerate(zip(wanted.items(), patterns, strict=True)):
        may = F.lit(False)
        for x in placed:
            if x.field is f:
                some = F.lit(True)
                for slot in x.slots:
                    one = F.lit(False)
                    for t in slot.terms:
                        one = one | (F.col(count[f, t]) > 0)
                    some = some & one
                may = may | some
        own = [t for t in terms if any(x.field is f and t in x.terms for x in placed)]
        if own:
            df = once(df, [F.when(may, words(F.col(f"_t{i}")) if p else F.col(f"_t{i}")).alias(f"_w{i}")])
        for t in own:
            place[f, t] = f"_p{i}_{terms.index(t)}"
            at = F.array_compact(F.transform(F.col(f"_w{i}"), _at(t))) if p else _places(F.col(f"_w{i}"), t)
            places.append(F.coalesce(at, F.array().cast("array<int>")).alias(place[f, t]))
    return df.select(*keep, *length.values(), *count.values(), *places), place, count, length


def _at(term: str) -> Callable[[Column, Column], Column]:
    return lambda word, place: F.when(word == term, place)


def _places(tokens: Column, term: str) -> Column:
    return F.transform(F.filter(tokens, lambda t: t["term"] == term), lambda t: t["pos"])
