import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.engine import EngineConfig, SearchEngine
from lexmill.errors import DurabilityError, IndexLifecycleError, InvalidArgument
from lexmill.operators import indexes, textindex
from lexmill.operators.execute import Searcher
from lexmill.operators.indexes import Accuracy, IndexDefinition, PlanningMode
from lexmill.plans import predicates as p
from lexmill.plans import ranked as r
from lexmill.plans.requests import SearchRequest
from lexmill.schema import IndexType, SearchSchema
from lexmill.sources import storage
from lexmill.streaming import replicas
from lexmill.streaming.microbatch import apply_batch

SCHEMA = T.StructType().add("id", "long").add("n", "long").add("body", "string")


def schema():
    return SearchSchema.from_struct(SCHEMA, "id", text=("body",))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return [x.id for x in df.collect()]


def test_an_index_is_built_beside_the_writer(spark, monkeypatch):
    s = schema()
    n, body = s.field("n"), s.text_field("body")
    with SearchEngine(spark, s, config=EngineConfig(planning=PlanningMode.FORCE_INDEX)) as e:
        e.apply_frame("add", frame(spark, [(i, i % 5, "java search" if i % 2 else "engine") for i in range(40)]))
        build = e.store.build_derived

        def slow(name, d, version):
            path = build(name, d, version)
            e.apply_frame("update", frame(spark, [(1, 4, "changed java"), (2, 0, "java")]))  # the writer isn't kept waiting
            e.apply_frame("remove", frame(spark, [(9, None, None)]))
            with pytest.raises(IndexLifecycleError):
                e.create_index(d)
            return path

        monkeypatch.setattr(e.store, "build_derived", slow)
        for d in (IndexDefinition(n, IndexType.RANGE), IndexDefinition(body, IndexType.TEXT)):
            monkeypatch.setattr(e.store, "build_derived", slow) if d.kind is IndexType.RANGE else monkeypatch.setattr(e.store, "build_derived", build)
            e.create_index_async(d).result(600)
        assert e._current.registry.touched.keys() == {"n:range"}
        plain = Searcher(e._current.df, s)
        for q in (p.between(n, 3, 4), p.eq(n, 0), p.term(body, "java")):
            assert ids(e.search(q)) == ids(plain.search(q))
        request = SearchRequest(r.text(body, "java"), limit=50)
        assert ids(e.search(request)) == ids(plain.top_k(request))
        assert e.metrics().index_builds == 2 and e.metrics().documents == 39


def test_tables_are_merged_at_a_checkpoint(spark, monkeypatch):
    s = schema()
    body, n = s.text_field("body"), s.field("n")
    with SearchEngine(spark, s) as e:
        e.apply_frame("add", frame(spark, [(i, i if i % 3 else None, f"word{i % 4} java") for i in range(30)]))
        e.create_index(IndexDefinition(body, IndexType.TEXT))
        e.create_index(IndexDefinition(n, IndexType.RANGE))
        e.apply_frame("update", frame(spark, [(1, None, "fresh java java"), (3, 77, None), (4, 5, "")]))
        e.apply_frame("remove", frame(spark, [(5, None, None)]))
        e.apply_frame("add", frame(spark, [(100, 1, "fresh start")]))
        monkeypatch.setattr(indexes, "build", lambda *a: pytest.fail("built anew"))
        e.checkpoint()
        monkeypatch.undo()
        registry, df = e._current.registry, e._current.df
        assert not registry.touched
        path = registry.path(body, IndexType.TEXT)
        same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert same(spark.read.parquet(f"{path}/postings").select("term", textindex.ORD, "tf", "positions", "dl"), textindex.postings(df, body).select("term", textindex.ORD, "tf", "positions", "dl"))
        assert same(spark.read.parquet(f"{path}/terms"), textindex.doc_freq(textindex.postings(df, body)))
        assert same(spark.read.parquet(f"{path}/stats"), textindex.corpus_stats(df, body).select("n_docs", "total_length"))
        assert same(spark.read.parquet(f"{registry.path(n, IndexType.RANGE)}/sorted").select(*df.columns), df.where("n IS NOT NULL"))
        assert sum(b[2] for b in registry.summary(spark, "n:range")) == df.count()


def test_custom_indexes_last_and_snapshots_keep_theirs(spark):
    s = schema()
    n = s.field("n")
    with SearchEngine(spark, s) as e:
        e.add_all([{"id": i, "n": i % 3, "body": None} for i in range(9)])
        e.create_index(IndexDefinition(n, "even", lambda q: (F.col("n") % 2 == 0, Accuracy.SUPERSET) if isinstance(q, p.Equal) and q.value == 2 else None))
        with pytest.raises(IndexLifecycleError):
            e.create_index(IndexDefinition(n, "even"))
        e.add_all([{"id": 50, "n": 2, "body": None}])
        pinned = e.snapshot()
        assert "n:even" in pinned.registry.by_name and ids(e.search(p.eq(n, 2))) == [2, 5, 8, 50]
        e.drop_index("n")
        assert "n:even" in pinned.registry.by_name and not e.snapshot().registry.by_name


def test_a_lock_ends_with_its_owner(spark, tmp_path, monkeypatch):
    s, path = schema(), str(tmp_path / "s")
    monkeypatch.setattr(storage, "LEASE_SECONDS", 1.5)
    lost = storage.SnapshotStore.open_store(spark, path, s)
    time.sleep(2.5)
    with pytest.raises(DurabilityError) as x:  # renewed
        storage.SnapshotStore.open_store(spark, path, s)
    assert x.value.reason is DurabilityError.Reason.STORAGE_IN_USE
    lost._closed.set()  # its process is gone
    time.sleep(2.5)
    storage.SnapshotStore.open_store(spark, path, s).close()


def test_formats_gate_what_a_store_does(spark, tmp_path):
    s = schema()
    d = IndexDefinition(s.field("n"), IndexType.RANGE)
    with SearchEngine(spark, s, str(tmp_path / "a"), storage_format=(1, 0)) as e, pytest.raises(DurabilityError) as x:
        e.create_index(d)
    assert x.value.reason is DurabilityError.Reason.UNSUPPORTED_FORMAT
    for name, form, warm in (("b", (1, 1), 0), ("c", (1, 2), 1)):
        with SearchEngine(spark, s, str(tmp_path / name), storage_format=form) as e:
            e.add_all([{"id": 1, "n": 1, "body": None}])
            e.create_index(d)
        with SearchEngine(spark, s, str(tmp_path / name)) as e:
            assert e.metrics_.warm_reopens == warm and ids(e.search(p.eq(s.field("n"), 1))) == [1]


def test_a_batch_isn_t_applied_again_after_cleanup(spark, tmp_path):
    s, path = schema(), str(tmp_path / "s")
    batch = spark.createDataFrame([(1, "upsert", 1, 5, "a")], "seq long, op string, id long, n long, body string")
    with SearchEngine(spark, s, path) as e:
        apply_batch(e, batch, 3, "in")
        e.checkpoint()
        e.remove_all([1])
    storage.apply_cleanup(spark, storage.plan_cleanup(spark, path))
    with SearchEngine(spark, s, path) as e:
        version = e.store.version
        assert apply_batch(e, batch, 3, "in") == version and ids(e.search(p.match_all())) == []
        assert apply_batch(e, batch, 4, "in") == version + 1


def test_replicas(spark, tmp_path):
    s = schema()
    folders = [str(tmp_path / k) for k in "abc"]
    row = lambda i: frame(spark, [(i, i, "x")]).select(F.lit(0).alias("pos"), F.lit("add").alias("op"), F.lit(i).cast("long").alias(textindex.ORD), "id", "n", "body")
    with pytest.raises(DurabilityError):
        replicas.activate(spark, folders, s)  # no store anywhere
    storage.SnapshotStore.open_store(spark, folders[0], s).close()
    store, group = replicas.activate(spark, folders, s)
    files = storage.Files(spark)
    assert group.epoch == 1 and group.commit(row(0), adds=1) == 1
    assert [replicas.position(files, f) for f in folders] == [(1, 1)] * 3
    files.delete(f"{folders[2]}/log/000000000001")  # one peer lags, and is delivered what it lacks
    assert group.commit(row(1), adds=1) == 2 and replicas.position(files, folders[2]) == (1, 2)
    replicas.promise(files, folders[1], 5)
    replicas.promise(files, folders[2], 5)
    with pytest.raises(DurabilityError) as x:  # both follow another by now
        group.commit(row(2), adds=1)
    assert x.value.reason is DurabilityError.Reason.WRITE_FAILED
    store.close()
    store, group = replicas.activate(spark, folders, s)
    assert store.path == folders[0] and group.epoch == 6 and [replicas.position(files, f)[1] for f in folders] == [3, 3, 3]
    store.checkpoint()
    new = str(tmp_path / "new")
    plan = replicas.plan_replica(spark, "bootstrap", folders[0], new)
    group.commit(row(3), adds=1)
    with pytest.raises(DurabilityError) as x:
        replicas.apply_replica(spark, plan)
    assert x.value.reason is DurabilityError.Reason.PLAN_MISMATCH
    assert replicas.apply_replica(spark, replicas.plan_replica(spark, "replace", folders[0], new)) == 4
    store.close()
    with SearchEngine(spark, s, new) as e:
        assert ids(e.search(p.match_all())) == [0, 1, 2, 3]
        with pytest.raises(DurabilityError):
            replicas.plan_replica(spark, "clear", folders[0], new)
    assert replicas.apply_replica(spark, replicas.plan_replica(spark, "clear", folders[0], new)) == -1 and not files.exists(new)
    for bad in ({"acks": 3}, {"peers": 0}, {"most_behind": 0}):
        with pytest.raises(InvalidArgument):
            replicas.ReplicationBounds(**bad)


def test_places_hold_where_results_have_parts(spark, tmp_path):
    from lexmill.lifecycle_queries import natural_order

    spark.range(4000).select((F.col("id") * 7 % 4000).alias("o_orderkey"), F.when(F.col("id") % 100 < 60, "P").otherwise("O").alias("o_orderstatus")).repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    expected = sorted(i * 7 % 4000 for i in range(4000) if i % 100 < 60)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted((x.place, x.o_orderkey) for x in natural_order(spark, str(tmp_path)).collect()) == list(enumerate(expected))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
