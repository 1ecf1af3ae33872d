import dataclasses
import random
from typing import Annotated

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.engine import EngineConfig, SearchEngine
from lexmill.errors import BulkMutationError, DocumentAlreadyExists, DocumentNotFound, DurabilityError, EngineRejected, IndexLifecycleError, InvalidArgument, InvalidState, ReplicaReadError, SchemaError
from lexmill.operators.indexes import Accuracy, IndexDefinition, PlanningMode
from lexmill.operators.execute import Searcher
from lexmill.operators.textindex import ORD
from lexmill.plans import predicates as p
from lexmill.plans import ranked as r
from lexmill.plans.requests import HighlightedSearchRequest, SearchPageRequest, SearchRequest
from lexmill.product import CATEGORIES, ProductFilters, product_engine, product_schema
from lexmill.schema import IndexType, SearchId, SearchIndex, SearchSchema, SearchText, suggestion
from lexmill.sources import storage
from lexmill.streaming.reads import ReadOptions, ReadPolicy, ReadToken, resolve


@dataclasses.dataclass
class Article:
    id: Annotated[int, SearchId()]
    title: Annotated[str, SearchIndex(IndexType.PREFIX)]
    price: Annotated[int, SearchIndex(IndexType.RANGE)]
    body: Annotated[str, SearchText(), SearchIndex(IndexType.TEXT)]


def article(i, title="t", price=1, body="java"):
    return {"id": i, "title": title, "price": price, "body": body}


def rows(df):
    return [(x.id, x.title, x.price, x.body) for x in df.collect()]


def test_life_of_a_store(spark, tmp_path):
    schema, path = SearchSchema.from_dataclass(Article), str(tmp_path / "store")
    f = schema.field
    with SearchEngine(spark, schema, path) as e:
        e.add_all([article(2), article(1, "u", 5, "java search"), article(3, "v", 9, None)])
        with pytest.raises(DocumentAlreadyExists):
            e.add(article(2)).result(60)
        with pytest.raises(DocumentNotFound):
            e.update(article(8)).result(60)
        e.update(article(2, "new", 7, "search engine")).result(60)
        assert e.remove(99).result(60) == e.store.version
        assert [x[0] for x in rows(e.search(p.match_all()))] == [2, 1, 3]  # the order of insertion
        assert e.get(2).title == "new" and e.get(99) is None
        e.remove(1).result(60)
        e.add(article(1, "again", 2, "java java")).result(60)
        assert [x[0] for x in rows(e.search(p.between(f("price"), 1, 7)))] == [2, 1]
        assert [x[0] for x in rows(e.search(p.prefix(f("title"), "a")))] == [1]
        top = e.search_top_k(SearchRequest(r.text(schema.text_field("body"), "java search")))
        assert [x.id for x in top.collect()] == [1, 2] or [x.id for x in top.collect()] == [2, 1]
        assert e.explain(SearchRequest(r.text(schema.text_field("body"), "java")), 1).matched
        assert e.search_highlighted(HighlightedSearchRequest(SearchRequest(r.text(schema.text_field("body"), "java")), (schema.text_field("body"),))).count() == 1
        assert len(e.search_page(SearchPageRequest(SearchRequest(r.text(schema.text_field("body"), "java")))).hits.collect()) == 1
        with pytest.raises(DurabilityError) as x:
            SearchEngine(spark, schema, path)
        assert x.value.reason is DurabilityError.Reason.STORAGE_IN_USE
        before, version, commits = rows(e.search(p.match_all())), e.store.version, e.metrics().commits
        assert commits >= 4 and e.metrics().documents == 3
    storage.verify_store(spark, path)
    with SearchEngine(spark, schema, path) as e:  # from the log
        assert rows(e.search(p.match_all())) == before and e.store.version == version
        assert e.metrics_.warm_reopens > 0
        e.checkpoint()
        assert rows(e.search(p.match_all())) == before
        e.add(article(4)).result(60)
        e.backup(str(tmp_path / "backup"))
        plan = storage.plan_cleanup(spark, path)
        assert plan.files and storage.apply_cleanup(spark, plan) == plan.files
        assert storage.plan_cleanup(spark, path).files == ()
    with pytest.raises(EngineRejected):
        e.add(article(5))
    with SearchEngine(spark, schema, path) as e:  # from checkpoint and log
        assert [x[0] for x in rows(e.search(p.match_all()))] == [2, 3, 1, 4]
    assert storage.inspect_format(spark, path)["format"] == (1, 2) and storage.inspect_derived(spark, path)
    m = storage.verify_backup(spark, str(tmp_path / "backup"), schema)
    assert m["mark"]["rows"] == 4
    restored = storage.restore_backup(spark, str(tmp_path / "backup"), str(tmp_path / "restored"))
    assert restored["history"] != m["history"]
    with pytest.raises(DurabilityError):
        storage.restore_backup(spark, str(tmp_path / "backup"), str(tmp_path / "restored"))
    with SearchEngine(spark, schema, str(tmp_path / "restored")) as e:
        assert [x[0] for x in rows(e.search(p.match_all()))] == [2, 3, 1, 4]

    # migration
    target = SearchSchema.from_struct(T.StructType().add("sku", "string").add("score", "long"), "sku")
    good = lambda df: df.select(ORD, F.concat(F.lit("s"), F.col("id").cast("string")).alias("sku"), F.col("price").alias("score"))
    plan = storage.plan_migration(spark, str(tmp_path / "backup"), str(tmp_path / "moved"), good, target)
    with pytest.raises(DurabilityError) as x:
        storage.apply_migration(spark, plan, lambda df: good(df).withColumn("score", F.lit(0).cast("long")), target)
    assert x.value.reason is DurabilityError.Reason.PLAN_MISMATCH
    storage.apply_migration(spark, plan, good, target)
    assert storage.read_backup(spark, str(tmp_path / "moved")).count() == 4
    with pytest.raises(DurabilityError) as x:
        storage.plan_migration(spark, str(tmp_path / "backup"), str(tmp_path / "m2"), lambda df: good(df).withColumn("sku", F.lit("same")), target)
    assert x.value.reason is DurabilityError.Reason.DUPLICATE_KEY


def test_damage_is_found(spark, tmp_path):
    schema, path = SearchSchema.from_dataclass(Article), str(tmp_path / "s")
    with SearchEngine(spark, schema, path) as e:
        e.add_all([article(1)])
        e.add_all([article(2)])
        last = e.store.commits()[-1]
    files = storage.Files(spark)
    spark.createDataFrame([], storage.SnapshotStore(spark, path, schema, {}).log_schema).write.mode("overwrite").parquet(f"{path}/log/{last}/rows")
    with pytest.raises(DurabilityError) as x:
        storage.verify_store(spark, path)
    assert x.value.reason is DurabilityError.Reason.CORRUPT_LOG
    files.delete(f"{path}/log/{e.store.commits()[-2]}")
    with pytest.raises(DurabilityError):
        SearchEngine(spark, schema, path)
    other = SearchSchema.from_struct(T.StructType().add("id", "long"), "id")
    with pytest.raises(DurabilityError) as x:
        SearchEngine(spark, other, path)
    assert x.value.reason is DurabilityError.Reason.SCHEMA_MISMATCH


def test_batches_are_atomic(spark):
    schema = SearchSchema.from_struct(T.StructType().add("id", "long").add("v", "string"), "id")
    with SearchEngine(spark, schema, config=EngineConfig(max_batch_size=5)) as e:
        assert e.add_all([]) == 0
        e.add_all([{"id": 1, "v": "a"}, {"id": 2, "v": "b"}])
        for bad, error in (([{"id": 3}, {"id": 3}], BulkMutationError), ([{"id": i} for i in range(9, 19)], BulkMutationError), ([{"id": 4}, {"id": 1}], DocumentAlreadyExists), ([{"v": "x"}], InvalidArgument)):
            with pytest.raises(error):
                e.add_all(bad)
        with pytest.raises(DocumentNotFound):
            e.update_all([{"id": 1, "v": "z"}, {"id": 7, "v": "z"}])
        with e.read() as view:
            token = view.token
            assert view.get(2).v == "b" and view.sequence == e.store.version
        with pytest.raises(ReplicaReadError):
            view.get(2)
        e.remove_all([2, 7])
        with e.read(ReadOptions(ReadPolicy.AT_LEAST_INDEX, token)) as view:
            assert view.get(2) is None and view.sequence > token.index
        assert [(x.id, x.v) for x in e.search(p.match_all()).collect()] == [(1, "a")]
        e.apply_frame("add", spark.range(10, 20).select("id", F.lit("n").alias("v")))
        e.apply_frame("remove", spark.range(15, 30).select("id"))
        assert [x.id for x in e.search(p.match_all()).collect()] == [1, 10, 11, 12, 13, 14]
        with pytest.raises(DocumentAlreadyExists):
            e.apply_frame("add", spark.range(1, 2).select("id", F.lit("n").alias("v")))


def test_indexes_never_change_results(spark):
    rng = random.Random(42)
    schema = SearchSchema.from_struct(T.StructType().add("id", "long").add("s", "string").add("n", "long"), "id")
    s, n = schema.field("s"), schema.field("n")
    with SearchEngine(spark, schema) as e:
        e.apply_frame("add", spark.createDataFrame([(i, rng.choice([None, "a", "ab", "b"]), rng.choice([None, 1, 2, 3])) for i in range(40)], schema.struct))
        queries = [p.eq(s, "a"), p.eq(s, None), p.prefix(s, "a"), p.and_(p.between(n, 1, 2), p.not_(p.eq(s, "b"))), p.or_(p.eq(n, 3), p.eq(s, "b"))]
        before = [[x.id for x in e.search(q).collect()] for q in queries]
        for d in (IndexDefinition(s, IndexType.EQUALITY), IndexDefinition(s, IndexType.PREFIX), IndexDefinition(n, IndexType.RANGE)):
            e.create_index(d)
        with pytest.raises(IndexLifecycleError):
            e.create_index(IndexDefinition(n, IndexType.RANGE))
        with pytest.raises(InvalidArgument):
            e.create_index(IndexDefinition(n, IndexType.TEXT))
        assert [[x.id for x in e.search(q).collect()] for q in queries] == before
        e._current.mode = PlanningMode.FORCE_SCAN
        assert [[x.id for x in e.search(q).collect()] for q in queries] == before
        assert {x.name for x in e.index_statistics()} == {"s:equality", "s:prefix", "n:range"}
        e.drop_index("s")
        e.drop_index("s")
        e.create_index(IndexDefinition(s, "mine", lambda q: (F.col("s") >= q.value, Accuracy.SUPERSET) if isinstance(q, p.Equal) and q.value is not None and q.field is s else None))
        assert [[x.id for x in e.search(q).collect()] for q in queries] == before


def test_text_index_with_later_changes_scores_as_a_scan(spark):
    rng = random.Random(93)
    schema = SearchSchema.from_dataclass(Article)
    body = schema.text_field("body")
    words = ["java", "search", "engine", "café"]
    some = lambda i: article(i, "t", i % 4, None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))))
    with SearchEngine(spark, schema) as e:
        e.add_all([some(i) for i in range(20)])
        e.checkpoint()
        for _ in range(2):
            e.update_all([some(i) for i in rng.sample(range(20), 5) if e.get(i)])
            e.remove_all([rng.randrange(20)])
            e.add_all([some(100 + e.store.version)])
            assert e._current.registry.touched
            for q in (r.text(body, "java search"), r.phrase(body, "search engine", 1), r.fuzzy(body, "serach")):
                request = SearchRequest(q, limit=50)
                got = [(x.id, x.score) for x in e.search(request).collect()]
                e._current.mode = PlanningMode.FORCE_SCAN
                scan = Searcher(e._current.df, schema)
                assert got == [(x.id, x.score) for x in scan.top_k(request).collect()]
                e._current.mode = PlanningMode.COST_AWARE
            assert rows(e.search(p.between(schema.field("price"), 1, 2))) == rows(Searcher(e._current.df, schema).search(p.between(schema.field("price"), 1, 2)))
        e.checkpoint()
        assert not e._current.registry.touched


def test_stream(spark, tmp_path):
    schema = SearchSchema.from_struct(T.StructType().add("id", "long").add("v", "string"), "id")
    source = str(tmp_path / "in")
    log = T.StructType().add("seq", "long").add("op", "string").add("id", "long").add("v", "string")
    with SearchEngine(spark, schema) as e:
        for batch in ([(1, "upsert", 1, "a"), (2, "upsert", 2, "b"), (3, "upsert", 1, "c")], [(4, "remove", 2, None), (5, "upsert", 3, "d"), (6, "remove", 9, None)]):
            spark.createDataFrame(batch, log).coalesce(1).write.mode("append").parquet(source)
            q = e.stream(spark.readStream.schema(log).parquet(source), str(tmp_path / "cp"))
            q.processAllAvailable()
            q.stop()
        assert [(x.id, x.v) for x in e.search(p.match_all()).orderBy("id").collect()] == [(1, "c"), (3, "d")]
        from lexmill.streaming.microbatch import apply_batch

        version = e.store.version
        assert apply_batch(e, spark.createDataFrame(batch, log), 0, str(tmp_path / "cp")) == version


def test_read_tokens():
    t = ReadToken(b"g" * 16, b"h" * 16, b"d" * 32, 7)
    assert len(t.encode()) == 112 and ReadToken.decode(t.encode()) == t
    with pytest.raises(ReplicaReadError) as x:
        ReadToken.decode(t.encode()[:-1] + b"!")
    assert x.value.reason is ReplicaReadError.Reason.INVALID_TOKEN
    at_least = lambda token, wait=0.0: ReadOptions(ReadPolicy.AT_LEAST_INDEX, token, wait)
    assert resolve(ReadOptions(ReadPolicy.STALE_ALLOWED), b"h" * 16, 3, lambda: 9) == 3
    assert resolve(ReadOptions(), b"h" * 16, 3, lambda: 9) == 9
    assert resolve(at_least(t), b"h" * 16, 3, lambda: 8) == 8
    for options, history, reason in ((at_least(t), b"x" * 16, ReplicaReadError.Reason.INCOMPATIBLE_HISTORY), (at_least(t, 0.1), b"h" * 16, ReplicaReadError.Reason.PROGRESS_NOT_REACHED)):
        with pytest.raises(ReplicaReadError) as x:
            resolve(options, history, 3, lambda: 5)
        assert x.value.reason is reason


def test_product_engine(spark):
    with product_engine(spark) as e:
        f = ProductFilters(e.schema)
        e.add({"id": "1", "name": "lamp", "category": "HOME", "price": 5.0, "prime": True, "rating": 4.5}).result(60)
        assert [x.id for x in e.search(f.and_(f.name("la"), f.price_range(1, 9))).collect()] == ["1"]


def test_schema_and_products(spark):
    assert suggestion("titel", ["title", "body"]) == "title" and suggestion("xyz", ["title"]) is None
    with pytest.raises(SchemaError):
        SearchSchema.from_dataclass(int)
    schema = product_schema()
    f = ProductFilters(schema)
    df = spark.createDataFrame([("1", "lamp", "HOME", 5.0, True, 4.5), ("2", "book", "BOOKS", 9.0, False, 3.0), ("3", "late", "HOME", 7.0, False, 4.0)], schema.struct)
    s = Searcher.over(df, schema)
    ids = lambda q: [x.id for x in s.search(q).collect()]
    assert ids(f.and_(f.category("HOME"), f.rating(4.0))) == ["1", "3"]
    assert ids(f.or_(f.prime(), f.price_range(8, 10))) == ["1", "2"] and ids(f.not_(f.name("la"))) == ["2"]
    assert ids(p.between(schema.field("category"), CATEGORIES[0], CATEGORIES[1])) == ["2"]
    with SearchEngine(spark, SearchSchema.from_frame(df, "id", ("name",))) as e, pytest.raises(InvalidState):
        e.search(SearchRequest(r.text(e.schema.text_field("name"), "lamp")))
