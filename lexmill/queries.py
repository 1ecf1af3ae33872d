"""Queries over the test tables, one for each operator, and the equivalent DuckDB SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import EngineConfig, SearchEngine
from .functions.analysis import SimpleAnalyzer
from .functions.bm25 import Bm25Config
from .operators import fuzzy, indexes, textindex
from .operators.execute import Searcher
from .plans import predicates as p
from .plans import ranked as r
from .plans.requests import HighlightedSearchRequest, SearchPageRequest, SearchRequest, TotalHitsMode, ranked_request
from .product import ProductFilters
from .schema import Field, IndexType, SearchSchema, TextField
from .sources import storage
from .sources.storage import merged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


#: NFKC, lower case, runs of letters and digits. DuckDB has NFC alone, which is the same on the test corpus.
ANALYZER = SimpleAnalyzer()


def table(spark: SparkSession, sf_dir: str, name: str, key: str, text: tuple[str, ...] = ()) -> Searcher:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return Searcher.over(df, SearchSchema.from_frame(df, key, text, analyzer=ANALYZER))


def documents(spark: SparkSession, sf_dir: str) -> tuple[Searcher, TextField]:
    s = table(spark, sf_dir, "documents", "doc_id", ("text",))
    return s, s.schema.text_field("text")


def hits(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(key, F.round("score", 6).alias("score"))


def sql_between(f: Field, low: float, high: float) -> p.Query:
    """SQL's range. To SQL both zeros are one value; the engine puts -0.0 before 0.0, so a bound of zero is the outer one."""
    return p.between(f, -0.0 if low == 0 else low, 0.0 if high == 0 else high)


def sql_round(name: str, digits: int) -> Column:
    """DuckDB's rounding: scaled in binary, where Spark goes by decimal digits, which differs at ties; and zero keeps its sign."""
    c, scale = F.col(name), 10.0**digits
    whole = F.round(c * scale, 0)
    return F.when(whole == 0, c * 0.0).when(F.abs(whole) < float("inf"), whole / scale).otherwise(c).alias(name)


# -- structured conditions


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IS NOT DISTINCT FROM 'BUILDING'")
def eq_filter(spark, sf_dir):
    s = table(spark, sf_dir, "customer", "c_custkey")
    return s.search(p.eq(s.schema.field("c_mktsegment"), "BUILDING")).select("c_custkey", "c_name")


@query("SELECT event_id, event_type FROM events WHERE CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END IS NULL")
def eq_null(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = Field("kind", expression=lambda: F.expr("CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END"))
    s = Searcher.over(df, SearchSchema(Field("event_id", T.LongType()), [kind]))
    return s.search(p.eq(kind, None)).select("event_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE coalesce(l_quantity BETWEEN 10 AND 11 AND l_discount BETWEEN 0.02 AND 0.04, false)")
def range_filter(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem", "l_orderkey")
    f = s.schema.field
    return s.matching(p.and_(p.between(f("l_quantity"), 10.0, 11.0), p.between(f("l_discount"), 0.02, 0.04))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 10")
def range_reversed_empty(spark, sf_dir):
    s = table(spark, sf_dir, "orders", "o_orderkey")
    return s.search(p.between(s.schema.field("o_totalprice"), 1000.0, 10.0)).select("o_orderkey")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) BETWEEN 2 AND 3")
def range_declared_order(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = Field("o_orderkey", T.LongType())
    level = Field("o_orderpriority", order=("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"))
    return Searcher.over(df, SearchSchema(key, [level])).search(p.between(level, "4-NOT SPECIFIED", "3-MEDIUM")).select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey, p_name FROM part WHERE coalesce(starts_with(p_name, (SELECT substr(min(p_name), 1, 3) FROM part)), false)")
def prefix_filter(spark, sf_dir):
    s = table(spark, sf_dir, "part", "p_partkey")
    start = s.df.agg(F.min("p_name")).first()[0][:3]
    return s.search(p.prefix(s.schema.field("p_name"), start)).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE c_name IS NOT NULL")
def prefix_empty(spark, sf_dir):
    s = table(spark, sf_dir, "customer", "c_custkey")
    return s.search(p.prefix(s.schema.field("c_name"), "")).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice BETWEEN 1000 AND 200000) OR NOT starts_with(o_orderpriority, '5')")
def and_or_not(spark, sf_dir):
    s = table(spark, sf_dir, "orders", "o_orderkey")
    f = s.schema.field
    q = p.or_(p.and_(p.eq(f("o_orderstatus"), "F"), p.between(f("o_totalprice"), 1000.0, 200000.0)), p.not_(p.prefix(f("o_orderpriority"), "5")))
    return s.search(q).select("o_orderkey")


@query("SELECT event_id FROM events WHERE NOT coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END = 'click', false)")
def not_keeps_nulls(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = Field("kind", expression=lambda: F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END"))
    s = Searcher.over(df, SearchSchema(Field("event_id", T.LongType()), [kind]))
    return s.search(p.not_(p.eq(kind, "click"))).select("event_id")


@query("SELECT n_nationkey FROM nation")
def empty_and(spark, sf_dir):
    return table(spark, sf_dir, "nation", "n_nationkey").search(p.and_()).select("n_nationkey")


@query("SELECT n_nationkey FROM nation WHERE false")
def empty_or(spark, sf_dir):
    return table(spark, sf_dir, "nation", "n_nationkey").search(p.or_()).select("n_nationkey")


@query("SELECT r_regionkey, r_name FROM region")
def match_all(spark, sf_dir):
    return table(spark, sf_dir, "region", "r_regionkey").search(p.match_all()).select("r_regionkey", "r_name")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 = 3 AND s_acctbal > 0")
def custom_condition(spark, sf_dir):
    return table(spark, sf_dir, "supplier", "s_suppkey").search(p.custom(lambda: (F.col("s_suppkey") % 7 == 3) & (F.col("s_acctbal") > 0))).select("s_suppkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 900 AND 1500 AND NOT starts_with(p_name, 'a') AND (p_brand = 'Brand#11' OR (p_partkey % 2 = 0 AND p_size / 10.0 >= 2.5))")
def product_filters(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet")
    named = {"p_partkey": "id", "p_name": "name", "p_brand": "category", "p_retailprice": "price"}
    own = df.withColumnsRenamed(named).select("*", (F.col("id") % 2 == 0).alias("prime"), (F.col("p_size") / 10.0).alias("rating"))
    s = Searcher.over(own, SearchSchema.from_frame(own, "id"))
    f = ProductFilters(s.schema)
    return s.search(f.and_(f.or_(f.category("Brand#11"), f.and_(f.prime(), f.rating(2.5))), f.price_range(900, 1500), f.not_(f.name("a")))).select(F.col("id").alias("p_partkey"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7")
def get_by_id(spark, sf_dir):
    return table(spark, sf_dir, "customer", "c_custkey").get(7).select("c_custkey", "c_name", "c_acctbal")


# -- terms

_TOKENS = r"SELECT doc_id, lang, source, n_chars, coalesce(regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{Nd}]+'), []) AS t FROM documents"


@query(f"SELECT doc_id FROM ({_TOKENS}) WHERE list_contains(t, 'that')")
def term(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return s.search(p.term(text, "That")).select("doc_id")


@query(f"SELECT doc_id FROM ({_TOKENS}) WHERE list_has_any(t, ['the', 'der'])")
def any_terms(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return s.search(p.any_terms(text, "the, DER the")).select("doc_id")


@query(f"SELECT doc_id FROM ({_TOKENS}) WHERE list_has_all(t, ['of', 'with', 'that'])")
def all_terms(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return s.search(p.all_terms(text, "of with that")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE false")
def all_terms_empty(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return s.search(p.all_terms(text, " -- ")).select("doc_id")


# -- the text index

_POSTED = f"SELECT doc_id, len(t) AS dl, unnest(t) AS term, unnest(range(len(t))) AS pos FROM ({_TOKENS})"


@query(f"SELECT term, doc_id AS doc_ord, count(*)::INT AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions, first(dl)::INT AS dl FROM ({_POSTED}) GROUP BY term, doc_id")
def postings(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return textindex.postings(s.df, text).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@query(f"SELECT doc_id AS doc_ord, len(t)::INT AS dl FROM ({_TOKENS}) WHERE len(t) > 0")
def doc_lengths(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return textindex.doc_lengths(s.df, text)


@query(f"SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS total_length, round(sum(len(t)) / count(*) FILTER (len(t) > 0), 6) AS avgdl FROM ({_TOKENS})")
def corpus_stats(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return textindex.corpus_stats(s.df, text).withColumn("avgdl", F.round("avgdl", 6))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM ({_POSTED}) GROUP BY term")
def doc_freq(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return textindex.doc_freq(textindex.postings(s.df, text))


@query("SELECT 'o_orderpriority:equality' AS name, count(DISTINCT o_orderpriority) AS distinct_keys, count(o_orderpriority) AS indexed_documents FROM orders")
def index_statistics(spark, sf_dir):
    s = table(spark, sf_dir, "orders", "o_orderkey")
    x = indexes.statistics(s.df, indexes.IndexDefinition(s.schema.field("o_orderpriority"), IndexType.EQUALITY))
    return spark.createDataFrame([(x.name, x.distinct_keys, x.indexed_documents)], "name string, distinct_keys long, indexed_documents long")


# -- ranked searches


def _bm25(terms: list[str], k1: float = 1.2, b: float = 0.75) -> str:
    """A CTE ``scored`` with tf, one score per term and its presence."""
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = ", ".join(f"CASE WHEN tf{i} > 0 THEN (ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (tf{i} * ({k1} + 1.0))) / (tf{i} + {k1} * (1.0 - {b} + {b} * dl / avgdl)) ELSE 0 END AS s{i}" for i in range(len(terms)))
    return f"WITH docs AS ({_TOKENS}), tfs AS (SELECT *, len(t) AS dl, {tf} FROM docs), stats AS (SELECT count(*) FILTER (dl > 0) AS n, sum(dl) / count(*) FILTER (dl > 0) AS avgdl, {df} FROM tfs), scored AS (SELECT *, {score} FROM tfs, stats WHERE dl > 0)"


def _top(score: str, where: str, limit: int = 10) -> str:
    return f" SELECT doc_id, round({score}, 6) AS score FROM (SELECT *, {score} AS sc FROM scored WHERE {where} ORDER BY sc DESC, doc_id LIMIT {limit})"


@query(_bm25(["password", "with", "token"]) + _top("s0 + s1 + s2", "tf0 + tf1 + tf2 > 0"))
def bm25_topk(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return hits(s.top_k(SearchRequest(r.text(text, "password with token"))))


@query(_bm25(["of", "ed"]) + _top("s0 + s1", "tf0 + tf1 > 0 AND lang = 'en' AND n_chars BETWEEN 100 AND 1000", 20))
def bm25_filtered(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    f = s.schema.field
    only = p.and_(p.eq(f("lang"), "en"), p.between(f("n_chars"), 100, 1000))
    return hits(s.top_k(SearchRequest(r.text(text, "of ed"), only, 20)))


@query(_bm25(["la", "de"], 0.9, 0.4) + _top("s0 + s1", "tf0 + tf1 > 0"))
def bm25_custom_k1b(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return hits(s.top_k(SearchRequest(r.text(text, "la de"), config=Bm25Config(0.9, 0.4))))


@query(_bm25(["whatever", "it"]) + _top("s0 + s1", "tf0 + tf1 > 0", 5))
def bm25_single_field_request(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return hits(s.top_k(ranked_request(text, "whatever it", 5)))


@query(
    r"""WITH docs AS (SELECT page_id, regexp_extract_all(lower(url), '[\p{L}\p{Nd}]+') AS u, regexp_extract_all(lower(html), '[\p{L}\p{Nd}]+') AS h FROM pages),
    tfs AS (SELECT page_id, len(u) AS du, len(h) AS dh, len(list_filter(u, lambda x: x = 'blog')) AS a, len(list_filter(h, lambda x: x = 'the')) AS b FROM docs),
    stats AS (SELECT count(*) FILTER (du > 0) AS nu, sum(du) / count(*) FILTER (du > 0) AS au, count(*) FILTER (dh > 0) AS nh, sum(dh) / count(*) FILTER (dh > 0) AS ah, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM tfs),
    scored AS (SELECT *, CASE WHEN a > 0 THEN ln(1 + (nu - da + 0.5) / (da + 0.5)) * (a * 2.2) / (a + 1.2 * (0.25 + 0.75 * du / au)) ELSE 0 END + CASE WHEN b > 0 THEN ln(1 + (nh - db + 0.5) / (db + 0.5)) * (b * 2.2) / (b + 1.2 * (0.25 + 0.75 * dh / ah)) ELSE 0 END AS sc FROM tfs, stats)
    SELECT page_id, round(sc, 6) AS score FROM scored WHERE a > 0 AND b > 0 ORDER BY sc DESC, page_id LIMIT 10"""
)
def bm25_multi_field(spark, sf_dir):
    s = table(spark, sf_dir, "pages", "page_id", ("url", "html"))
    url, html = s.schema.text_field("url"), s.schema.text_field("html")
    return hits(s.top_k(SearchRequest(r.bool_().must(r.text(url, "blog")).must(r.text(html, "the")).build())), "page_id")


@query(_bm25(["of", "the"]) + _top("s0 + s1", "len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) > 0"))
def phrase_exact(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return hits(s.top_k(SearchRequest(r.phrase(text, "of the"))))


@query(_bm25(["that", "with"]) + _top("s0 + s1", "len(list_filter(range(1, len(t) + 1), lambda i: t[i] = 'that' AND list_contains(t[i + 1 : i + 3], 'with'))) > 0", 25))
def phrase_slop(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return hits(s.top_k(SearchRequest(r.phrase(text, "that with", 2), limit=25)))


@query(_bm25(["der", "die", "und"]) + _top("s0 + s1 + s2", "tf0 > 0"))
def bool_must_should(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return hits(s.top_k(SearchRequest(r.bool_().must(r.text(text, "der")).should(r.text(text, "die")).should(r.text(text, "und")).build())))


@query(_bm25(["der", "die", "und", "password"]) + _top("s0 + s1 + s2 + s3", "(tf0 > 0)::INT + (tf1 > 0)::INT + (tf2 > 0)::INT + (tf3 > 0)::INT >= 2", 30))
def bool_minimum_should_match(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    b = r.bool_()
    for w in ("der", "die", "und", "password"):
        b = b.should(r.text(text, w))
    return hits(s.top_k(SearchRequest(b.minimum_should_match(2).build(), limit=30)))


@query(_bm25(["en", "la"]) + _top("s0 * 2.5 + s1", "tf0 + tf1 > 0"))
def boost(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return hits(s.top_k(SearchRequest(r.bool_().should(r.text(text, "en").boost(2.5)).should(r.text(text, "la")).build())))


_NEAR = f"WITH vocab AS (SELECT DISTINCT term FROM ({_POSTED})) SELECT term, damerau_levenshtein(term, 'with')::INT AS distance FROM vocab WHERE length(term) BETWEEN 3 AND 5 AND damerau_levenshtein(term, 'with') <= 1"


@query(_NEAR)
def fuzzy_expand(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return fuzzy.expansions(textindex.vocabulary(s.df, text, fuzzy.lengths("with")), "with")


@query(
    f"""WITH docs AS ({_TOKENS}), near AS ({_NEAR}), stats AS (SELECT count(*) FILTER (len(t) > 0) AS n, sum(len(t)) / count(*) FILTER (len(t) > 0) AS avgdl FROM docs),
    tfs AS (SELECT doc_id, term, distance, first(dl) AS dl, count(*) AS tf FROM ({_POSTED}) JOIN near USING (term) GROUP BY doc_id, term, distance),
    dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
    one AS (SELECT doc_id, distance, (ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2)) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * (1 - distance / greatest(length(term), 4)) AS s FROM tfs JOIN dfs USING (term), stats),
    best AS (SELECT doc_id, CASE WHEN min(distance) = 0 THEN max(s) FILTER (distance = 0) ELSE max(s) END AS sc FROM one GROUP BY doc_id)
    SELECT doc_id, round(sc, 6) AS score FROM best ORDER BY sc DESC, doc_id LIMIT 10"""
)
def fuzzy_search(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return hits(s.top_k(SearchRequest(r.fuzzy(text, "with"))))


# -- pages


@query(_bm25(["that"]) + _top("s0", "tf0 > 0", 15))
def page_1(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    return hits(s.page(SearchPageRequest(SearchRequest(r.text(text, "that"), limit=15))).hits)


@query(_bm25(["that"]) + " SELECT doc_id, round(s0, 6) AS score FROM (SELECT * FROM scored WHERE tf0 > 0 ORDER BY s0 DESC, doc_id LIMIT 15 OFFSET 15)")
def page_2(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    request = SearchPageRequest(SearchRequest(r.text(text, "that"), limit=15))
    first = s.page(request)
    return hits((s.page(request.next(first.next)) if first.next else first).hits)


@query(_bm25(["that"]) + " SELECT count(*) AS total FROM scored WHERE tf0 > 0")
def page_exact_total(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    page = s.page(SearchPageRequest(SearchRequest(r.text(text, "that"), limit=1), totals=TotalHitsMode.EXACT))
    return spark.createDataFrame([(page.total,)], "total long")


# -- state changes

_LOG = "SELECT event_id AS seq, (event_id * 37) % 20000 AS o_orderkey, CASE WHEN event_id % 5 = 0 THEN 'remove' ELSE 'update' END AS op, value AS o_totalprice FROM events WHERE event_id <= {upto}"


def _merge_sql(upto: int | str) -> str:
    return f"""WITH log AS ({_LOG.format(upto=upto)}), every AS (SELECT -1 AS seq, o_orderkey, 'add' AS op, o_totalprice FROM orders UNION ALL SELECT * FROM log),
    last AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) AS rn FROM every)
    SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM last WHERE rn = 1 AND op <> 'remove'"""


def _merge(spark: SparkSession, sf_dir: str, upto: int) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias(textindex.ORD), "o_orderkey", "o_totalprice")
    log = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_id") <= upto)
    log = log.select(F.col("event_id").alias("seq"), F.lit(0).alias("pos"), F.when(F.col("event_id") % 5 == 0, "remove").otherwise("update").alias("op"), F.lit(None).cast("long").alias(textindex.ORD), (F.col("event_id") * 37 % 20000).alias("o_orderkey"), F.col("value").alias("o_totalprice"))
    return merged(base, log, "o_orderkey").select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query(_merge_sql(10**12))
def mutation_merge(spark, sf_dir):
    return _merge(spark, sf_dir, 10**12)


@query(_merge_sql("(SELECT max(event_id) // 2 FROM events)"))
def replay(spark, sf_dir):
    """The collection as it was at a point in the middle of the log."""
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0]
    return _merge(spark, sf_dir, last // 2)


@query("SELECT p_partkey + 1000000 AS sku, upper(p_name) AS title, p_size::BIGINT AS score FROM part")
def migration_projection(spark, sf_dir):
    """A backup, a plan bound to it, and its application to another schema."""
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_size")
    path = _folder(spark, "migration")
    storage.write_backup(df, f"{path}/old", SearchSchema.from_frame(df, "p_partkey"))
    target = SearchSchema.from_struct(T.StructType().add("sku", "long").add("title", "string").add("score", "long"), "sku")
    move = lambda old: old.select(textindex.ORD, (F.col("p_partkey") + 1000000).alias("sku"), F.upper("p_name").alias("title"), F.col("p_size").cast("long").alias("score"))
    plan = storage.plan_migration(spark, f"{path}/old", f"{path}/new", move, target)
    storage.apply_migration(spark, plan, move, target)
    return storage.read_backup(spark, f"{path}/new").select("sku", "title", "score")


# -- stored collections


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lexmill-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@query(_bm25(["password", "with", "token"]) + _top("s0 + s1 + s2", "tf0 + tf1 + tf2 > 0"))
def bm25_from_postings(spark, sf_dir):
    """The same search from a stored text index."""
    s, text = documents(spark, sf_dir)
    d, path = indexes.IndexDefinition(text, IndexType.TEXT), _folder(spark, "index")
    indexes.build(s.df, d, path, s.schema.id_field.column)
    registry = indexes.IndexRegistry()
    registry.add(d, path)
    return hits(Searcher(s.df, s.schema, registry, strict=True).top_k(SearchRequest(r.text(text, "password with token"))))


_CHANGED = """SELECT c_custkey, c_name, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 7 <> 0
    UNION ALL SELECT c_custkey + 10000000, c_name, c_acctbal FROM customer WHERE c_custkey % 50 = 0"""


@query(f"SELECT c_custkey, c_name, round(c_acctbal, 4) AS c_acctbal FROM ({_CHANGED}) WHERE c_acctbal BETWEEN 0 AND 5000")
def durable_changes(spark, sf_dir):
    """Adds, updates and removals, a checkpoint and a recovery; then a search through a range index that is older than the last change."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal")
    schema, path = SearchSchema.from_frame(df, "c_custkey"), _folder(spark, "store")
    balance = schema.field("c_acctbal")
    with SearchEngine(spark, schema, path) as e:
        e.apply_frame("add", df)
        e.create_index(indexes.IndexDefinition(balance, IndexType.RANGE))
        e.checkpoint()
        e.apply_frame("update", df.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1))
        e.apply_frame("remove", df.where("c_custkey % 7 = 0"))
    with SearchEngine(spark, schema, path) as e:
        e.apply_frame("add", df.where("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 10000000))
        return e.search(sql_between(balance, 0.0, 5000.0)).select("c_custkey", "c_name", sql_round("c_acctbal", 4))


@query("SELECT p_partkey, p_name FROM part")
def backup_and_restore(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    schema, path = SearchSchema.from_frame(df, "p_partkey"), _folder(spark, "backup")
    with SearchEngine(spark, schema, f"{path}-store") as e:
        e.apply_frame("add", df)
        e.backup(path)
    storage.verify_backup(spark, path, schema)
    storage.restore_backup(spark, path, f"{path}-restored")
    with SearchEngine(spark, schema, f"{path}-restored") as e:
        return e.search(p.match_all()).select("p_partkey", "p_name")


# -- planned searches


def _indexed(spark, sf_dir, name: str, key: str, field: str, kind: IndexType, mode: indexes.PlanningMode = indexes.PlanningMode.FORCE_INDEX, text: tuple[str, ...] = ()) -> Searcher:
    """A table with one stored index."""
    s, path = table(spark, sf_dir, name, key, text), _folder(spark, "index")
    d = indexes.IndexDefinition(s.schema.field(field), kind)
    indexes.build(s.df, d, path, s.schema.id_field.column)
    registry = indexes.IndexRegistry()
    registry.add(d, path)
    return Searcher(s.df, s.schema, registry, mode=mode)


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice BETWEEN 1000 AND 100000")
def index_equality(spark, sf_dir):
    s = _indexed(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", IndexType.EQUALITY)
    f = s.schema.field
    return s.search(p.and_(p.eq(f("o_orderpriority"), "2-HIGH"), p.between(f("o_totalprice"), 1000.0, 100000.0))).select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, (SELECT substr(min(p_name), 1, 3) FROM part))")
def index_prefix(spark, sf_dir):
    s = _indexed(spark, sf_dir, "part", "p_partkey", "p_name", IndexType.PREFIX)
    start = s.df.agg(F.min("p_name")).first()[0][:3]
    return s.search(p.prefix(s.schema.field("p_name"), start)).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN 100 AND 400")
def index_range(spark, sf_dir):
    s = _indexed(spark, sf_dir, "customer", "c_custkey", "c_acctbal", IndexType.RANGE, indexes.PlanningMode.COST_AWARE)
    return s.search(p.between(s.schema.field("c_acctbal"), 100.0, 400.0)).select("c_custkey")


@query(f"SELECT doc_id FROM ({_TOKENS}) WHERE list_has_all(t, ['that', 'with']) AND lang = 'en'")
def index_terms(spark, sf_dir):
    s = _indexed(spark, sf_dir, "documents", "doc_id", "text", IndexType.TEXT, text=("text",))
    return s.search(p.and_(p.all_terms(s.schema.text_field("text"), "that with"), p.eq(s.schema.field("lang"), "en"))).select("doc_id")


@query(
    """SELECT 'p_size = 7' AS condition, count(*) AS cardinality, count(DISTINCT p_size) AS sources FROM part WHERE p_size = 7
    UNION ALL SELECT 'p_size 10 to 20', count(*), count(DISTINCT p_size) FROM part WHERE p_size BETWEEN 10 AND 20 UNION ALL SELECT 'p_size 20 to 10', 0, 0"""
)
def index_estimate(spark, sf_dir):
    """What an index's summary promises: the sum of its blocks in a range, exact where a key is a block."""
    s = _indexed(spark, sf_dir, "part", "p_partkey", "p_size", IndexType.RANGE)
    size = s.schema.field("p_size")
    conditions = {"p_size = 7": p.eq(size, 7), "p_size 10 to 20": p.between(size, 10, 20), "p_size 20 to 10": p.between(size, 20, 10)}
    found = {k: s.estimate(q) for k, q in conditions.items()}
    return spark.createDataFrame([(k, e.cardinality, e.sources) for k, e in found.items()], "condition string, cardinality long, sources long")


@query("SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 11 <> 0) WHERE c_acctbal BETWEEN 0 AND 3000")
def index_build_beside_writes(spark, sf_dir):
    """An index is built while others write; what they changed is replayed when it is published."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_acctbal")
    schema, path = SearchSchema.from_frame(df, "c_custkey"), _folder(spark, "store")
    balance = schema.field("c_acctbal")
    with SearchEngine(spark, schema, path, EngineConfig(planning=indexes.PlanningMode.FORCE_INDEX)) as e:
        e.apply_frame("add", df)
        built = e.create_index_async(indexes.IndexDefinition(balance, IndexType.RANGE))
        e.apply_frame("update", df.where("c_custkey % 5 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 100))
        e.apply_frame("remove", df.where("c_custkey % 11 = 0"))
        built.result(600)
        return e.search(sql_between(balance, 0.0, 3000.0)).select("c_custkey", sql_round("c_acctbal", 4))


# -- explanations and highlights


@query(_bm25(["of", "the"]) + " SELECT term, tf, df, round(score, 6) AS score FROM (SELECT 'of' AS term, tf0 AS tf, df0 AS df, s0 AS score, doc_id FROM scored UNION ALL SELECT 'the', tf1, df1, s1, doc_id FROM scored) WHERE doc_id = (SELECT min(doc_id) FROM scored WHERE tf0 > 0 AND tf1 > 0)")
def explain_terms(spark, sf_dir):
    """What each term adds to the score of the first document that has both."""
    s, text = documents(spark, sf_dir)
    key = s.matching(p.all_terms(text, "of the")).agg(F.min("doc_id")).first()[0]
    found = s.explain(SearchRequest(r.text(text, "of the")), key)
    parts = found.children[0].children if found else ()
    return spark.createDataFrame([(c.detail["term"], c.detail["tf"], c.detail["df"], round(c.score, 6)) for c in parts], "term string, tf long, df long, score double")


@query(
    _bm25(["of", "the"])
    + r""", best AS (SELECT doc_id FROM scored WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) > 0 ORDER BY s0 + s1 DESC, doc_id LIMIT 10),
    parts AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS t, regexp_split_to_array(lower(text), '[\p{L}\p{Nd}]+') AS gaps FROM documents JOIN best USING (doc_id)),
    found AS (SELECT *, list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')[1] AS k FROM parts),
    spans AS (SELECT doc_id, text, list_sum(list_transform(gaps[1 : k], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(t[1 : k - 1], lambda w: length(w))), 0)::BIGINT AS a, length(gaps[k + 1]) AS gap FROM found)
    SELECT doc_id, 'text' AS field, greatest(0, a - 40)::INT AS start, least(length(text), a + 2 + gap + 3 + 40)::INT AS "end", substr(text, (greatest(0, a - 40) + 1)::BIGINT, (least(length(text), a + gap + 45) - greatest(0, a - 40))::BIGINT) AS text FROM spans"""
)
def highlight_fragments(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    df = s.highlight(HighlightedSearchRequest(SearchRequest(r.phrase(text, "of the")), (text,)))
    return df.select("doc_id", F.explode("highlights").alias("h")).select("doc_id", "h.field", F.explode("h.fragments").alias("f")).select("doc_id", "field", "f.start", "f.end", "f.text")
