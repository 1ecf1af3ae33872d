"""The engine: a durable or in-memory collection that is searched at pinned versions and changed in batches.

Searches return DataFrames of the version that is published when they are made; a mutation is checked,
logged as one commit and then published. There is one writer; readers never wait for it.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import Future
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from queue import Empty, Full, Queue

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import BulkMutationError, DocumentAlreadyExists, DocumentNotFound, DurabilityError, EngineRejected, IndexLifecycleError, InvalidArgument, ReplicaReadError
from .operators import indexes as index_ops
from .operators.execute import Page, Searcher
from .operators.indexes import IndexDefinition, IndexRegistry, PlanningMode
from .operators.textindex import ORD
from .plans.evaluate import Explanation
from .plans.predicates import Query
from .plans.requests import HighlightedSearchRequest, SearchPageRequest, SearchRequest
from .schema import IndexType, SearchSchema
from .sources.codecs import Codec
from .sources.storage import SnapshotStore
from .streaming.reads import ReadOptions, ReadToken, resolve


@dataclass(frozen=True)
class EngineConfig:
    queue_capacity: int = 100_000
    max_batch_size: int = 1_000
    max_wait_seconds: float = 0.005
    #: Commits since the last checkpoint that bring about the next.
    checkpoint_commits: int = 64
    planning: PlanningMode = PlanningMode.COST_AWARE

    def __post_init__(self) -> None:
        if min(self.queue_capacity, self.max_batch_size, self.checkpoint_commits) < 1 or self.max_wait_seconds < 0:
            raise InvalidArgument(f"{self}")


@dataclass
class Metrics:
    version: int = 0
    documents: int = -1
    submitted: int = 0
    completed: int = 0
    failed: int = 0
    rejected: int = 0
    commits: int = 0
    batches: int = 0
    largest_batch: int = 0
    queue_depth: int = 0
    index_builds: int = 0
    index_build_failures: int = 0
    warm_reopens: int = 0
    checkpoints: int = 0
    searches: int = 0
    closed: bool = False


@dataclass
class ReadView:
    """Reads of one captured version (no paging)."""

    _searcher: Searcher
    token: ReadToken
    active: bool = True

    def _own(self) -> Searcher:
        if not self.active:
            raise ReplicaReadError("the view's block has ended", ReplicaReadError.Reason.VIEW_NOT_ACTIVE)
        return self._searcher

    @property
    def sequence(self) -> int:
        return self._own().version

    def get(self, key: object) -> Row | None:
        return self._own().get(key).drop(ORD).first()

    def search(self, what: Query | SearchRequest) -> DataFrame:
        return self._own().search(what) if isinstance(what, Query) else self._own().top_k(what)

    def search_top_k(self, request: SearchRequest) -> DataFrame:
        return self._own().top_k(request)

    def search_highlighted(self, request: HighlightedSearchRequest) -> DataFrame:
        return self._own().highlight(request)

    def explain(self, request: SearchRequest, key: object) -> Explanation | None:
        return self._own().explain(request, key)


@dataclass
class _Task:
    op: str
    value: object
    future: Future = field(default_factory=Future)


class SearchEngine:
    """``SearchEngine(spark, schema)`` lives in a folder of its own under ``spark.checkpoint.dir``; with ``path`` it is durable.

    ``add``, ``update`` and ``remove`` return futures and are put together in micro-batches, in which one that fails
    leaves the others alone. ``add_all``, ``update_all`` and ``remove_all`` are atomic. ``apply_frame`` takes a whole
    DataFrame as one atomic commit, without passing rows through the driver.
    """

    def __init__(self, spark: SparkSession, schema: SearchSchema, path: str | None = None, config: EngineConfig | None = None, storage_format: tuple[int, int] = (1, 2), codec: Codec | None = None):
        self.spark, self.schema, self.config = spark, schema, config or EngineConfig()
        self.id = uuid.uuid4().hex
        self.store = SnapshotStore.open_store(spark, path or _own_folder(spark), schema, storage_format, codec)
        self.metrics_ = Metrics()
        self._builds: set[str] = set()
        self._custom: dict[str, IndexDefinition] = {}
        self._counted = (-1, -1)
        self._queue: Queue[_Task] = Queue(self.config.queue_capacity)
        self._write = threading.RLock()
        self._closed = False
        self._current: Searcher = None  # type: ignore[assignment]
        self._current = self._pin(self._registry())
        wanted = [IndexDefinition(schema.field(n), k) for n, kinds in schema.indexes.items() for k in kinds]
        for d in wanted:
            if d.name not in self._current.registry.by_name:
                self.create_index(d)
        self._writer = threading.Thread(target=self._run, daemon=True)
        self._writer.start()

    # -- snapshots

    def _registry(self) -> IndexRegistry:
        """Indexes as they are: a table built at an earlier version serves with what changed since, until the next checkpoint."""
        registry = IndexRegistry()
        for name in sorted(self.store.indexes):
            field_name, _, kind = name.partition(":")
            d = IndexDefinition(self.schema.field(field_name), IndexType(kind))
            path, touched, how = self.store.derived(name, d)
            self.metrics_.warm_reopens += how == "warm"
            registry.add(d, path, touched)
        for d in self._custom.values():
            registry.add(d)
        known = self._current.registry.summaries if self._current else {}
        registry.summaries = {path: known[path] for path in registry.paths.values() if path in known}
        return registry

    def _pin(self, registry: IndexRegistry) -> Searcher:
        return Searcher(self.store.at(), self.schema, registry, self.store.version, self.id, self.config.planning, strict=True)

    def snapshot(self, options: ReadOptions | None = None) -> Searcher:
        """The published version, or that which a read policy asks for."""
        if self._closed:
            raise EngineRejected("the engine is closed", EngineRejected.Reason.CLOSED)
        current = self._current
        if options is not None:
            version = resolve(options, bytes.fromhex(self.store.manifest["history"]), current.version, lambda: self._current.version)
            current = self._current if version >= self._current.version else current
        return current

    @contextmanager
    def read(self, options: ReadOptions | None = None) -> Iterator[ReadView]:
        """A view of one version, for as long as the block lasts."""
        view = ReadView(self.snapshot(options), self.token())
        try:
            yield view
        finally:
            view.active = False

    def token(self) -> ReadToken:
        """What is published now; a later read at this token sees it or more."""
        digest = hashlib.sha256(json.dumps(self.store.manifest, sort_keys=True).encode()).digest()
        return ReadToken(b"\0" * 16, bytes.fromhex(self.store.manifest["history"]), digest, self._current.version)

    # -- reads

    def get(self, key: object) -> Row | None:
        return self._read().get(key).drop(ORD).first()

    def _read(self) -> Searcher:
        self.metrics_.searches += 1
        return self.snapshot()

    def search(self, what: Query | SearchRequest) -> DataFrame:
        s = self._read()
        return s.search(what) if isinstance(what, Query) else s.top_k(what)

    def search_top_k(self, request: SearchRequest) -> DataFrame:
        return self._read().top_k(request)

    def search_page(self, page: SearchPageRequest) -> Page:
        return self._read().page(page)

    def search_highlighted(self, request: HighlightedSearchRequest) -> DataFrame:
        return self._read().highlight(request)

    def explain(self, request: SearchRequest, key: object) -> Explanation | None:
        return self._read().explain(request, key)

    # -- single mutations

    def _submit(self, op: str, value: object) -> Future:
        task = _Task(op, value)
        if self._closed:
            self.metrics_.rejected += 1
            raise EngineRejected("the engine is closed", EngineRejected.Reason.CLOSED)
        try:
            self._queue.put_nowait(task)
        except Full:
            self.metrics_.rejected += 1
            raise EngineRejected(f"{self.config.queue_capacity} wait already", EngineRejected.Reason.QUEUE_FULL) from None
        self.metrics_.submitted += 1
        return task.future

    def add(self, document: dict | Row) -> Future:
        return self._submit("add", document)

    def update(self, document: dict | Row) -> Future:
        return self._submit("update", document)

    def remove(self, key: object) -> Future:
        return self._submit("remove", key)

    def _run(self) -> None:
        while True:
            try:
                tasks = [self._queue.get(timeout=0.05)]
            except Empty:
                if self._closed:
                    return
                continue
            while len(tasks) < self.config.max_batch_size:
                try:
                    tasks.append(self._queue.get(timeout=self.config.max_wait_seconds))
                except Empty:
                    break
            try:
                self._batch(tasks)
            except Exception as e:  # noqa: BLE001  goes to whoever waits
                for t in tasks:
                    if not t.future.done():
                        t.future.set_exception(e)
                        self.metrics_.failed += 1

    def _batch(self, tasks: list[_Task]) -> None:
        """Apply in order against the ids that are there; those that can't be applied fail alone."""
        name = self.schema.id_field.name
        with self._write:
            keys = [t.value if t.op == "remove" else _value(t.value, name) for t in tasks]
            present = self._present([k for k in keys if k is not None])
            rows, done, adds = [], [], 0
            for t, key in zip(tasks, keys, strict=True):
                if key is None:
                    t.future.set_exception(InvalidArgument("a document without an id"))
                elif t.op == "add" and key in present:
                    t.future.set_exception(DocumentAlreadyExists(f"{key!r}"))
                elif t.op == "update" and key not in present:
                    t.future.set_exception(DocumentNotFound(f"{key!r}"))
                else:
                    if t.op == "add":
                        present.add(key)
                    if t.op == "remove":
                        if key not in present:
                            done.append(t)
                            continue
                        present.discard(key)
                    rows.append(self._row(t.op, len(rows), self.store.next_ord + adds if t.op == "add" else None, t.value))
                    adds += t.op == "add"
                    done.append(t)
                    continue
                self.metrics_.failed += 1
            if rows:
                self._commit(self.spark.createDataFrame(rows, self._row_schema()), "BULK" if len(rows) > 1 else "SINGLE", adds)
            self.metrics_.batches += 1
            self.metrics_.largest_batch = max(self.metrics_.largest_batch, len(tasks))
            for t in done:
                t.future.set_result(self.store.version)
                self.metrics_.completed += 1

    def _row_schema(self) -> T.StructType:
        return T.StructType(self.store.log_schema.fields[1:])

    def _row(self, op: str, pos: int, at: int | None, value: object) -> tuple:
        names = self.schema.struct.names
        own = [value if n == self.schema.id_field.name else None for n in names] if op == "remove" else [_value(value, n) for n in names]
        return (pos, op, at, *own)

    def _present(self, keys: Sequence[object]) -> set:
        """Which of a batch's keys are there."""
        if not keys:
            return set()
        ids = self.spark.createDataFrame([(k,) for k in set(keys)], T.StructType([T.StructField("_key", self.schema.id_field.type)]))
        return {r[0] for r in self.store.having(F.broadcast(ids)).select(self.schema.id_field.column).collect()}  # a batch's keys

    def _commit(self, rows: DataFrame | None, kind: str, adds: int = 0, **meta) -> int:
        seq = self.store.commit(rows, kind, adds, **meta)
        self.metrics_.commits += 1
        if seq - self.store.manifest["seq"] >= self.config.checkpoint_commits:
            self.checkpoint()
        self._current = self._pin(self._registry())
        return seq

    # -- atomic batches

    def _all(self, op: str, values: Iterable[object]) -> int:
        values = list(values)
        if self._closed:
            raise EngineRejected("the engine is closed", EngineRejected.Reason.CLOSED)
        if not values:
            return self.store.version
        if len(values) > self.config.max_batch_size:
            raise BulkMutationError(f"{len(values)} of {self.config.max_batch_size}", BulkMutationError.Reason.TOO_LARGE)
        name = self.schema.id_field.name
        keys = [v if op == "remove" else _value(v, name) for v in values]
        if any(k is None for k in keys):
            raise InvalidArgument("a document without an id")
        if len(set(keys)) < len(keys):
            raise BulkMutationError("an id is there twice", BulkMutationError.Reason.DUPLICATE_ID)
        with self._write:
            present = self._present(keys)
            if op == "add" and present:
                raise DocumentAlreadyExists(f"{sorted(present, key=str)[:3]}")
            if op == "update" and len(present) < len(keys):
                raise DocumentNotFound(f"{sorted((k for k in keys if k not in present), key=str)[:3]}")
            rows = [self._row(op, i, self.store.next_ord + i if op == "add" else None, v) for i, v in enumerate(values) if op != "remove" or keys[i] in present]
            return self._commit(self.spark.createDataFrame(rows, self._row_schema()), "BULK", len(rows) if op == "add" else 0) if rows else self.store.version

    def add_all(self, documents: Iterable[dict | Row]) -> int:
        return self._all("add", documents)

    def update_all(self, documents: Iterable[dict | Row]) -> int:
        return self._all("update", documents)

    def remove_all(self, keys: Iterable[object]) -> int:
        return self._all("remove", keys)

    def apply_frame(self, op: str, df: DataFrame) -> int:
        """One atomic commit of a table of any size: ids that are there twice, adds of ids that are there and updates of ids
        that aren't, fail it as a whole. Checks are joins and aggregates."""
        from .sources.storage import numbered

        name, own = self.schema.id_field.name, self.schema.struct.names
        with self._write:
            if not df.groupBy(name).count().where("count > 1").isEmpty():
                raise BulkMutationError("an id is there twice", BulkMutationError.Reason.DUPLICATE_ID)
            here = self.store.at().select(name)
            if op == "add" and not df.join(here, name, "left_semi").isEmpty():
                raise DocumentAlreadyExists("an id is there already")
            if op == "update" and not df.join(here, name, "left_anti").isEmpty():
                raise DocumentNotFound("an id isn't there")
            adds = df.count() if op == "add" else 0
            if op == "remove":
                rows = df.select(name).join(here, name, "left_semi").select(*[F.col(n) if n == name else F.lit(None).cast(self.schema.struct[n].dataType).alias(n) for n in own])
            else:
                rows = df.select(*own)
            rows = numbered(rows, name).withColumn(ORD, F.col(ORD) + self.store.next_ord) if op == "add" else rows.withColumn(ORD, F.lit(None).cast("long"))
            return self._commit(rows.withColumn("pos", F.lit(0)).withColumn("op", F.lit(op)), "BULK", adds)

    def stream(self, df: DataFrame, checkpoint: str, op: Callable[[DataFrame], DataFrame] | None = None):
        """Mutations from a streaming DataFrame of the fields and ``op``; see ``streaming.microbatch``."""
        from .streaming.microbatch import start

        return start(self, df, checkpoint, op)

    # -- indexes

    def create_index(self, d: IndexDefinition) -> int:
        """Build an index as of now beside the writer, which goes on; what it commits meanwhile is replayed when the index is published. A custom
        index is published at once, and lasts as long as the engine."""
        self.schema.check(d.field)
        with self._write:
            if d.name in self._builds:
                raise IndexLifecycleError(d.name, IndexLifecycleError.Reason.BUILD_IN_PROGRESS)
            if d.name in self._current.registry.by_name:
                raise IndexLifecycleError(d.name, IndexLifecycleError.Reason.ALREADY_EXISTS)
            if d.kind is IndexType.PREFIX and not isinstance(d.field.type, T.StringType):
                raise InvalidArgument(f"{d.field.name!r} is no string")
            IndexRegistry().add(d)
            if not isinstance(d.kind, IndexType):
                self._custom[d.name] = d
                self._current = self._pin(self._registry())
                return self.store.version
            if tuple(self.store.manifest["format"]) < (1, 1):
                raise DurabilityError(f"format {self.store.manifest['format']} has no indexes", DurabilityError.Reason.UNSUPPORTED_FORMAT)
            self._builds.add(d.name)
            version = self.store.version
        try:
            self.store.build_derived(d.name, d, version)
            with self._write:
                self.store.indexes[d.name] = version
                try:
                    seq = self._commit(None, "INDEX_CREATE", index=d.name, at=version)
                except Exception:
                    self.store.indexes.pop(d.name, None)
                    raise
                self.metrics_.index_builds += 1
                return seq
        except Exception:
            self.metrics_.index_build_failures += 1
            raise
        finally:
            self._builds.discard(d.name)

    def create_index_async(self, d: IndexDefinition) -> Future:
        """The same in a thread of its own."""
        out: Future = Future()

        def run() -> None:
            try:
                out.set_result(self.create_index(d))
            except Exception as e:  # noqa: BLE001  goes to whoever waits
                out.set_exception(e)

        threading.Thread(target=run, daemon=True).start()
        return out

    def drop_index(self, field_name: str) -> int:
        """Drop all indexes of a field; nothing to drop is no failure. Snapshots that are read keep theirs."""
        self.schema.field(field_name)
        with self._write:
            for n in [n for n, d in self._custom.items() if d.field.name == field_name]:
                self._custom.pop(n)
            for n in [n for n in self.store.indexes if n.partition(":")[0] == field_name]:
                self.store.indexes.pop(n)
                self._commit(None, "INDEX_DROP", index=n)
            self._current = self._pin(self._registry())
            return self.store.version

    def index_statistics(self) -> list[index_ops.IndexStatistics]:
        s = self.snapshot()
        return [index_ops.statistics(s.df, d) for d in s.registry.by_name.values() if isinstance(d.kind, IndexType)]

    # -- durability and life

    def checkpoint(self) -> int:
        with self._write:
            self.metrics_.checkpoints += 1
            seq = self.store.checkpoint()
            self._current = self._pin(self._registry())
            return seq

    def backup(self, target: str) -> dict:
        with self._write:
            out = self.store.backup(target)
            self._current = self._pin(self._registry())
            return out

    def metrics(self) -> Metrics:
        current = self._current
        if self._counted[0] != current.version:
            self._counted = (current.version, current.df.count())
        return replace(self.metrics_, version=current.version, documents=self._counted[1], queue_depth=self._queue.qsize(), closed=self._closed)

    def close(self) -> None:
        """No more mutations; those that wait are done first."""
        if not self._closed:
            self._closed = True
            self._writer.join()
            self.store.close()

    def __enter__(self) -> SearchEngine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def _own_folder(spark: SparkSession) -> str:
    """In the folder that the cluster shares; a local one only where none is named."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='lexmill-')}/store-{uuid.uuid4().hex}"


def _value(document: object, name: str) -> object:
    if isinstance(document, dict):
        return document.get(name)
    return document[name] if isinstance(document, Row) else getattr(document, name)
