"""Queries over the test tables that exercise stored collections, their changes, indexes, copies and failures, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine import EngineConfig, SearchEngine
from .errors import DocumentAlreadyExists, DocumentNotFound, EngineError, InvalidArgument, InvalidState, SearchCursorError
from .functions.analysis import FunctionAnalyzer, SimpleAnalyzer, Token
from .functions.bm25 import Bm25Config
from .operators import fuzzy, indexes, textindex
from .operators.execute import Searcher
from .plans import predicates as p
from .plans import ranked as r
from .plans.requests import SearchPageRequest, SearchRequest
from .queries import _TOKENS, _folder, _indexed, documents, query, table
from .schema import IndexType, SearchSchema
from .sources import storage
from .sources.codecs import json_codec
from .sources.files import settled
from .streaming import replicas
from .streaming.microbatch import apply_batch
from .streaming.reads import ReadOptions, ReadPolicy


def _store(spark, sf_dir, name: str, key: str, columns: list[str]) -> tuple[SearchSchema, str, object]:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
    return SearchSchema.from_frame(df, key), _folder(spark, "store"), df


def _cases(spark, rows: list[tuple[str, str]]):
    return spark.createDataFrame(rows, "case string, outcome string")


def _failure(run) -> str:
    """The kind of failure, and its reason where it has one."""
    try:
        run()
    except EngineError as e:
        return type(e).__name__ + (f" {e.reason.name}" if getattr(e, "reason", None) else "")
    return "none"


# -- changes


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 10 THEN upper(n_name) || '!' ELSE n_name END AS n_name FROM nation WHERE n_nationkey % 4 <> 3")
def atomic_batches(spark, sf_dir):
    """add_all, update_all and remove_all; a batch with one bad row changes nothing."""
    schema, path, df = _store(spark, sf_dir, "nation", "n_nationkey", ["n_nationkey", "n_name"])
    rows = [x.asDict() for x in df.collect()]  # 25 rows
    with SearchEngine(spark, schema, path) as e:
        e.add_all(rows)
        e.update_all([x | {"n_name": x["n_name"].upper() + "!"} for x in rows if x["n_nationkey"] < 10])
        e.remove_all([x["n_nationkey"] for x in rows if x["n_nationkey"] % 4 == 3])
        try:
            e.add_all([{"n_nationkey": 1000, "n_name": "new"}, rows[0]])
        except DocumentAlreadyExists:
            pass
        return e.search(p.match_all()).select("n_nationkey", "n_name")


@query("SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'changed' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 2")
def micro_batches(spark, sf_dir):
    """Single mutations put together by the writer: those that fail leave the others alone."""
    schema, path, df = _store(spark, sf_dir, "region", "r_regionkey", ["r_regionkey", "r_name"])
    with SearchEngine(spark, schema, path) as e:
        futures = [e.add(x.asDict()) for x in df.orderBy("r_regionkey").collect()]
        futures += [e.add({"r_regionkey": 0, "r_name": "twice"}), e.update({"r_regionkey": 1, "r_name": "changed"}), e.remove(2), e.update({"r_regionkey": 99, "r_name": "none"})]
        failed = [type(f.exception(600)) for f in futures]
        assert [x for x in failed if x is not type(None)] == [DocumentAlreadyExists, DocumentNotFound]
        return e.search(p.match_all()).select("r_regionkey", "r_name")


@query(
    """WITH log AS (SELECT event_id AS seq, event_id // 1000 AS batch, (event_id * 37) % 500 AS id, CASE WHEN event_id % 5 = 0 THEN 'remove' ELSE 'upsert' END AS op, value FROM events WHERE event_id < 3000),
    last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM log) SELECT id, round(value, 4) AS value FROM last WHERE rn = 1 AND op = 'upsert'"""
)
def stream_batches(spark, sf_dir):
    """Three micro-batches of a stream of upserts and removals, one of them delivered twice."""
    log = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id < 3000")  # three batches are the feature
    log = log.select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 1000).alias("batch"), (F.col("event_id") * 37 % 500).alias("id"), F.when(F.col("event_id") % 5 == 0, "remove").otherwise("upsert").alias("op"), "value")
    schema = SearchSchema.from_struct(T.StructType().add("id", "long").add("value", "double"), "id")
    with SearchEngine(spark, schema, _folder(spark, "store")) as e:
        for k in (0, 1, 1, 2):
            apply_batch(e, log.where(F.col("batch") == k).drop("batch"), k, "events")
        return e.search(p.match_all()).select("id", F.round("value", 4).alias("value"))


# -- indexes


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 7 AND s_suppkey % 9 <> 0")
def custom_index(spark, sf_dir):
    """A custom index lasts over later commits; its candidates are a superset."""
    schema, path, df = _store(spark, sf_dir, "supplier", "s_suppkey", ["s_suppkey", "s_name", "s_nationkey"])
    nation = schema.field("s_nationkey")
    near = lambda q: (F.col("s_nationkey").between(q.value - 1, q.value + 1), indexes.Accuracy.SUPERSET) if isinstance(q, p.Equal) and q.field is nation else None
    with SearchEngine(spark, schema, path) as e:
        e.apply_frame("add", df)
        e.create_index(indexes.IndexDefinition(nation, "near", near))
        e.apply_frame("remove", df.where("s_suppkey % 9 = 0"))
        assert "s_nationkey:near" in e.snapshot().registry.by_name
        return e.search(p.eq(nation, 7)).select("s_suppkey", "s_name")


@query("SELECT * FROM (VALUES ('before', 1, 25), ('pinned after drop', 1, 25), ('current', 0, 20)) t(moment, indexes, documents)")
def pinned_snapshots(spark, sf_dir):
    """What was pinned keeps its indexes and rows, whatever is dropped and removed later."""
    schema, path, df = _store(spark, sf_dir, "nation", "n_nationkey", ["n_nationkey", "n_name"])
    with SearchEngine(spark, schema, path) as e:
        e.apply_frame("add", df)
        e.create_index(indexes.IndexDefinition(schema.field("n_name"), IndexType.PREFIX))
        pinned = e.snapshot()
        state = lambda moment, s: (moment, len(s.registry.by_name), s.matching(p.match_all()).count())
        rows = [state("before", pinned)]
        e.drop_index("n_name")
        e.apply_frame("remove", df.where("n_nationkey < 5"))
        return spark.createDataFrame([*rows, state("pinned after drop", pinned), state("current", e.snapshot())], "moment string, indexes int, documents int")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND CASE WHEN c_custkey % 4 = 0 THEN 'MACHINERY' ELSE c_mktsegment END = 'MACHINERY'")
def merged_index(spark, sf_dir):
    """A checkpoint's index table is merged from the one before and what changed since."""
    schema, path, df = _store(spark, sf_dir, "customer", "c_custkey", ["c_custkey", "c_mktsegment"])
    segment = schema.field("c_mktsegment")
    with SearchEngine(spark, schema, path, EngineConfig(planning=indexes.PlanningMode.FORCE_INDEX)) as e:
        e.apply_frame("add", df)
        e.create_index(indexes.IndexDefinition(segment, IndexType.EQUALITY))
        e.apply_frame("update", df.where("c_custkey % 4 = 0").withColumn("c_mktsegment", F.lit("MACHINERY")))
        e.apply_frame("remove", df.where("c_custkey % 3 = 0"))
        e.checkpoint()
        assert not e.snapshot().registry.touched
        return e.search(p.eq(segment, "MACHINERY")).select("c_custkey")


@query(f"SELECT 'text:text' AS name, count(DISTINCT term) AS distinct_keys, count(DISTINCT doc_id) AS indexed_documents FROM (SELECT doc_id, unnest(t) AS term FROM ({_TOKENS}))")
def text_index_statistics(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    x = indexes.statistics(s.df, indexes.IndexDefinition(text, IndexType.TEXT))
    return spark.createDataFrame([(x.name, x.distinct_keys, x.indexed_documents)], "name string, distinct_keys long, indexed_documents long")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 20000 AND 21000 AND o_orderstatus = 'F'")
def planning_modes(spark, sf_dir):
    """The same rows by the cost-aware plan, a forced index and a forced scan."""
    found = []
    for mode in indexes.PlanningMode:
        s = _indexed(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", IndexType.RANGE, mode)
        f = s.schema.field
        found.append(s.search(p.and_(p.between(f("o_totalprice"), 20000.0, 21000.0), p.eq(f("o_orderstatus"), "F"))).select("o_orderkey", "o_totalprice"))
    first = found[0]
    for other in found[1:]:
        assert first.exceptAll(other).isEmpty() and other.exceptAll(first).isEmpty()
    return first


# -- ranked searches


@query(
    """WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
    SELECT p_partkey FROM t WHERE len(list_filter(range(1, len(w)), lambda i: w[i] IN ('small', 'tiny') AND w[i + 1] = 'ring')) > 0"""
)
def slot_alternatives(spark, sf_dir):
    """A phrase with alternatives at one place, from an analyzer of the user's own."""

    def analyse(text: str) -> list[Token]:
        out = []
        for w in text.split():
            out += [Token("small"), Token("tiny", 0)] if w == "SMALL" else [Token(w)]
        return out

    df = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    s = Searcher.over(df, SearchSchema.from_frame(df, "p_partkey", ("p_name",), analyzer=FunctionAnalyzer(analyse)))
    return s.scored(SearchRequest(r.phrase(s.schema.text_field("p_name"), "SMALL ring"))).select("p_partkey")


@query(
    f"""WITH vocab AS (SELECT DISTINCT unnest(t) AS term FROM ({_TOKENS})),
    near AS (SELECT term, damerau_levenshtein(term, 'there') AS d FROM vocab WHERE length(term) BETWEEN 4 AND 6 AND damerau_levenshtein(term, 'there') <= 1)
    SELECT row_number() OVER (ORDER BY d, term) - 1 AS place, term, d::INT AS distance FROM near"""
)
def expansion_order(spark, sf_dir):
    """The nearest terms first, then by code points."""
    s, text = documents(spark, sf_dir)
    found = fuzzy.expand(textindex.vocabulary(s.df, text, fuzzy.lengths("there")), "there")
    return spark.createDataFrame([(i, t, d) for i, (t, d) in enumerate(found)], "place long, term string, distance int")


@query("SELECT * FROM (VALUES ('fullwidth', 'full ２ width', true), ('ligature', 'fine print', true), ('roman', 'chapter iv', true), ('composed', 'café', true), ('other', 'nothing', false)) t(name, wanted, matched)")
def nfkc_terms(spark, sf_dir):
    """Compatibility forms are found by their plain ones, and the other way round."""
    texts = {"fullwidth": "ＦＵＬＬ 2 ｗｉｄｔｈ", "ligature": "ﬁne print", "roman": "Chapter Ⅳ", "composed": "café", "other": "ＦＵＬＬ"}
    wanted = {"fullwidth": "full ２ width", "ligature": "fine print", "roman": "chapter iv", "composed": "café", "other": "nothing"}
    df = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(texts.items())], "id long, name string, body string")
    s = Searcher.over(df, SearchSchema.from_frame(df, "id", ("body",), analyzer=SimpleAnalyzer()))
    body = s.schema.text_field("body")
    rows = [(n, w, not s.matching(p.and_(p.all_terms(body, w), p.eq(s.schema.field("name"), n))).isEmpty()) for n, w in wanted.items()]
    return spark.createDataFrame(rows, "name string, wanted string, matched boolean")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def natural_order(spark, sf_dir):
    """Rows come in the order of their ids: each one's place in what the search returns."""
    s = table(spark, sf_dir, "orders", "o_orderkey")
    found = s.search(p.eq(s.schema.field("o_orderstatus"), "P")).select("o_orderkey")
    # Settled with their parts: another run may draw other ranges, put parts together otherwise, or leave out the sort under a count.
    parts = settled(found.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    before = parts.groupBy("part").count().collect()  # a row per partition
    start, total = {}, 0
    for part, n in sorted((x[0], x[1]) for x in before):
        start[part], total = total, total + n
    first = F.create_map(*[x for k, v in start.items() for x in (F.lit(k), F.lit(v))]) if start else F.create_map().cast("map<int,int>")
    return parts.select((F.element_at(first, F.col("part")) + F.col("at")).cast("long").alias("place"), "o_orderkey")


# -- failures


@query(
    """SELECT * FROM (VALUES ('not a cursor', 'SearchCursorError UNSUPPORTED_CURSOR'), ('other engine', 'SearchCursorError DIFFERENT_ENGINE'), ('other request', 'SearchCursorError DIFFERENT_REQUEST'),
    ('other version', 'SearchCursorError STALE_SNAPSHOT'), ('its own', 'none')) t("case", outcome)"""
)
def cursor_checks(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    request = SearchPageRequest(SearchRequest(r.text(text, "that"), limit=2))
    cursor = s.page(request).next
    other = SearchPageRequest(SearchRequest(request.search.query, limit=2))
    tries = {
        "not a cursor": lambda: s.page(request.next(object())),
        "other engine": lambda: Searcher(s.df, s.schema, engine="other").page(request.next(cursor)),
        "other request": lambda: s.page(other.next(cursor)),
        "other version": lambda: Searcher(s.df, s.schema, version=2).page(request.next(cursor)),
        "its own": lambda: s.page(request.next(cursor)),
    }
    assert issubclass(SearchCursorError, EngineError)
    return _cases(spark, [(k, _failure(f)) for k, f in tries.items()])


@query(
    """SELECT * FROM (VALUES ('no clause', 'InvalidState'), ('too many of the optional', 'InvalidArgument'), ('zero without a required one', 'InvalidArgument'), ('a boost of zero', 'InvalidArgument'),
    ('a slop below zero', 'InvalidArgument'), ('two fuzzy words', 'InvalidArgument'), ('no text index', 'InvalidState'), ('a range without an end', 'InvalidArgument'), ('a prefix of a number', 'InvalidArgument'),
    ('two terms for one', 'InvalidArgument'), ('a field of another schema', 'InvalidArgument'), ('a negative k1', 'InvalidArgument'), ('a limit of zero', 'InvalidArgument'), ('no query', 'InvalidState')) t("case", outcome)"""
)
def request_checks(spark, sf_dir):
    s, text = documents(spark, sf_dir)
    other, _ = documents(spark, sf_dir)
    f = s.schema.field
    strict = Searcher(s.df, s.schema, strict=True)
    tries = {
        "no clause": lambda: r.bool_().build(),
        "too many of the optional": lambda: r.bool_().should(r.text(text, "a")).minimum_should_match(2).build(),
        "zero without a required one": lambda: r.bool_().should(r.text(text, "a")).minimum_should_match(0).build(),
        "a boost of zero": lambda: r.text(text, "a").boost(0),
        "a slop below zero": lambda: r.phrase(text, "a b", -1),
        "two fuzzy words": lambda: s.top_k(SearchRequest(r.fuzzy(text, "two words"))),
        "no text index": lambda: strict.top_k(SearchRequest(r.text(text, "that"))),
        "a range without an end": lambda: p.between(f("n_chars"), 1, None),
        "a prefix of a number": lambda: p.prefix(f("n_chars"), "1"),
        "two terms for one": lambda: p.term(text, "two terms"),
        "a field of another schema": lambda: s.search(p.eq(other.schema.field("lang"), "en")),
        "a negative k1": lambda: Bm25Config(-1.0),
        "a limit of zero": lambda: SearchRequest(r.text(text, "a"), limit=0),
        "no query": lambda: SearchRequest(),
    }
    assert issubclass(InvalidArgument, EngineError) and issubclass(InvalidState, EngineError)
    return _cases(spark, [(k, _failure(t)) for k, t in tries.items()])


# -- durability, reads and copies


@query("SELECT s_suppkey, s_name, round(s_acctbal, 4) AS s_acctbal FROM supplier WHERE s_suppkey % 4 <> 1")
def codec_round_trip(spark, sf_dir):
    """A collection that a codec of its own writes, as JSON, through its log, a checkpoint, a backup and a restored store."""
    schema, path, df = _store(spark, sf_dir, "supplier", "s_suppkey", ["s_suppkey", "s_name", "s_acctbal"])
    codec = json_codec()
    with SearchEngine(spark, schema, path, codec=codec) as e:
        e.apply_frame("add", df)
        e.backup(f"{path}-backup")
    assert _failure(lambda: SearchEngine(spark, schema, path)) == "DurabilityError SCHEMA_MISMATCH"
    assert storage.read_backup(spark, f"{path}-backup", codec).columns == [textindex.ORD, "s_suppkey", "s_name", "s_acctbal"]
    storage.restore_backup(spark, f"{path}-backup", f"{path}-restored")
    with SearchEngine(spark, schema, f"{path}-restored", codec=codec) as e:
        e.apply_frame("remove", df.where("s_suppkey % 4 = 1"))
        return e.search(p.match_all()).select("s_suppkey", "s_name", F.round("s_acctbal", 4).alias("s_acctbal"))


@query(
    """SELECT 'documents' AS measure, (SELECT count(*) FROM nation WHERE n_nationkey % 2 = 0) AS value UNION ALL SELECT 'commits', 3 UNION ALL SELECT 'checkpoints', 1
    UNION ALL SELECT 'index_builds', 1 UNION ALL SELECT 'searches', 2 UNION ALL SELECT 'rejected', 0 UNION ALL SELECT 'queue_depth', 0"""
)
def engine_metrics(spark, sf_dir):
    schema, path, df = _store(spark, sf_dir, "nation", "n_nationkey", ["n_nationkey", "n_name"])
    with SearchEngine(spark, schema, path) as e:
        e.apply_frame("add", df)
        e.create_index(indexes.IndexDefinition(schema.field("n_name"), IndexType.PREFIX))
        e.apply_frame("remove", df.where("n_nationkey % 2 = 1"))
        e.checkpoint()
        e.search(p.match_all())
        e.search(p.prefix(schema.field("n_name"), "N"))
        m = e.metrics()
    names = ("documents", "commits", "checkpoints", "index_builds", "searches", "rejected", "queue_depth")
    return spark.createDataFrame([(n, getattr(m, n)) for n in names], "measure string, value long")


@query("SELECT * FROM (VALUES ('unfinished commits', 0), ('old commits', 3), ('old checkpoints', 1), ('left after cleanup', 0), ('format', 12), ('documents', 20)) t(item, n)")
def inspect_and_clean(spark, sf_dir):
    """What a store holds that nothing needs, its removal by a plan, and the store after it."""
    schema, path, df = _store(spark, sf_dir, "nation", "n_nationkey", ["n_nationkey", "n_name"])
    with SearchEngine(spark, schema, path) as e:
        e.apply_frame("add", df)
        e.checkpoint()
        e.apply_frame("update", df.where("n_nationkey < 3").withColumn("n_name", F.lit("x")))
        e.apply_frame("remove", df.where("n_nationkey >= 20"))
        e.checkpoint()
    plan = storage.plan_cleanup(spark, path)
    storage.apply_cleanup(spark, plan)
    storage.verify_store(spark, path)
    major, minor = storage.inspect_format(spark, path)["format"]
    with SearchEngine(spark, schema, path) as e:
        n = e.search(p.match_all()).count()
    count = lambda start: len([x for x in plan.files if x.startswith(start)])
    rows = [("unfinished commits", count("log/_")), ("old commits", count("log/0")), ("old checkpoints", count("checkpoint/")), ("left after cleanup", len(storage.plan_cleanup(spark, path).files)), ("format", 10 * major + minor), ("documents", n)]
    return spark.createDataFrame(rows, "item string, n long")


@query("SELECT * FROM (VALUES ('stale', 25), ('at the token', 20), ('latest', 20), ('view that ended', -1)) t(read, documents)")
def read_policies(spark, sf_dir):
    """Which version a reader sees: what it holds, one no older than a token, the latest; a view ends with its block."""
    schema, path, df = _store(spark, sf_dir, "nation", "n_nationkey", ["n_nationkey", "n_name"])
    count = lambda s: s.search(p.match_all()).count()
    with SearchEngine(spark, schema, path) as e:
        e.apply_frame("add", df)
        with e.read(ReadOptions(ReadPolicy.STALE_ALLOWED)) as held:
            e.apply_frame("remove", df.where("n_nationkey >= 20"))
            rows = [("stale", count(held))]
        with e.read(ReadOptions(ReadPolicy.AT_LEAST_INDEX, e.token(), 5.0)) as view:
            rows.append(("at the token", count(view)))
        with e.read() as view:
            rows.append(("latest", count(view)))
        rows.append(("view that ended", -1 if _failure(lambda: view.search(p.match_all())) == "ReplicaReadError VIEW_NOT_ACTIVE" else 0))
    return spark.createDataFrame(rows, "read string, documents long")


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN 'after' ELSE n_name END AS n_name FROM nation WHERE n_nationkey <> 24")
def replicated_commits(spark, sf_dir):
    """Commits that a peer holds too; the primary is lost, a peer is activated, and the old primary can't commit any more."""
    schema, path, df = _store(spark, sf_dir, "nation", "n_nationkey", ["n_nationkey", "n_name"])
    folders = [f"{path}/{k}" for k in "abc"]
    storage.SnapshotStore.open_store(spark, folders[0], schema).close()
    first, group = replicas.activate(spark, folders, schema)
    log = lambda rows, op, at: rows.select(F.lit(0).alias("pos"), F.lit(op).alias("op"), at.cast("long").alias(textindex.ORD), "n_nationkey", "n_name")
    group.commit(log(df, "add", F.col("n_nationkey")), adds=df.count())
    group.commit(log(df.where("n_nationkey = 24"), "remove", F.lit(None)))
    first.close()
    storage.Files(spark).move(folders[0], f"{path}/lost")
    second, group_2 = replicas.activate(spark, folders, schema)
    assert second.path == folders[1] and group_2.epoch == group.epoch + 1
    assert _failure(lambda: group.commit(None)) == "DurabilityError INCOMPATIBLE_HISTORY"
    group_2.commit(log(df.where("n_nationkey < 3").withColumn("n_name", F.lit("after")), "update", F.lit(None)))
    plan = replicas.plan_replica(spark, "bootstrap", folders[1], f"{path}/new")
    assert replicas.apply_replica(spark, plan) == second.version
    second.close()
    with SearchEngine(spark, schema, f"{path}/new") as e:
        return e.search(p.match_all()).select("n_nationkey", "n_name")


@query("SELECT * FROM (VALUES ('U+10000 to U+E000', 2), ('U+E000 to U+10000', 0), ('a to U+FFFD', 4), ('a to U+D7FF', 1)) t(\"range\", n)")
def utf16_ranges(spark, sf_dir):
    """Ranges of strings go by UTF-16 units: characters beyond U+FFFF come before U+E000."""
    private, last, beyond = chr(0xE000), chr(0xFFFD), chr(0x10000)
    df = spark.createDataFrame(list(enumerate(["b", beyond, private, last])), "id long, s string")
    s = Searcher.over(df, SearchSchema.from_frame(df, "id"))
    f = s.schema.field("s")
    ranges = {"U+10000 to U+E000": (beyond, private), "U+E000 to U+10000": (private, beyond), "a to U+FFFD": ("a", last), "a to U+D7FF": ("a", chr(0xD7FF))}
    return spark.createDataFrame([(k, s.matching(p.between(f, *v)).count()) for k, v in ranges.items()], "range string, n long")


@query("SELECT * FROM (VALUES ('whole', 'none'), ('a commit changed', 'DurabilityError CORRUPT_LOG'), ('a commit missing', 'DurabilityError CORRUPT_LOG'), ('a checkpoint missing', 'DurabilityError MISSING_FILE'), ('another schema', 'DurabilityError SCHEMA_MISMATCH'), ('open elsewhere', 'DurabilityError STORAGE_IN_USE')) t(\"case\", outcome)")
def damage_is_found(spark, sf_dir):
    """What verification and opening say of stores that were damaged, each in a copy."""
    schema, path, df = _store(spark, sf_dir, "region", "r_regionkey", ["r_regionkey", "r_name"])
    with SearchEngine(spark, schema, path) as e:
        e.apply_frame("add", df)
        e.checkpoint()
        e.apply_frame("remove", df.where("r_regionkey = 1"))
        e.apply_frame("remove", df.where("r_regionkey = 2"))
    files = storage.Files(spark)
    checkpoint, commits = files.read(f"{path}/MANIFEST.json")["checkpoint"], [n for n in files.list(f"{path}/log") if n.isdigit()]

    def copy(name: str) -> str:
        files.make(f"{path}-copies")
        files.copy(path, f"{path}-copies/{name}")
        return f"{path}-copies/{name}"

    def changed(name: str) -> str:
        to = copy(name)
        files.delete(f"{to}/log/{commits[-1]}/rows")
        files.copy(f"{path}/log/{commits[-2]}/rows", f"{to}/log/{commits[-1]}/rows")
        return to

    def without(name: str, part: str) -> str:
        to = copy(name)
        files.delete(f"{to}/{part}")
        return to

    whole = copy("whole")
    other = SearchSchema.from_struct(T.StructType().add("r_regionkey", "long"), "r_regionkey")
    rows = [("whole", _failure(lambda: storage.verify_store(spark, whole)))]
    for case, to in (("a commit changed", changed("changed")), ("a commit missing", without("gap", f"log/{commits[-2]}")), ("a checkpoint missing", without("base", f"checkpoint/{checkpoint}"))):
        rows.append((case, _failure(lambda to=to: storage.verify_store(spark, to))))
    rows.append(("another schema", _failure(lambda: SearchEngine(spark, other, whole))))
    with SearchEngine(spark, schema, whole):
        rows.append(("open elsewhere", _failure(lambda: SearchEngine(spark, schema, whole))))
    return _cases(spark, rows)
