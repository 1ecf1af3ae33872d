"""A durable collection: a mutation log and checkpoints, as immutable Parquet folders.

A commit is a folder of log rows that appears at once, by a rename; its sequence number is its name. A checkpoint is the
merged collection at a sequence number, and the manifest that points at it is replaced at once. The collection at a version is the
checkpoint with the later log rows merged in: of each id the last row wins.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DurabilityError
from ..operators import indexes as index_ops
from ..operators.textindex import ORD
from ..schema import SearchSchema
from .codecs import Codec, Columns
from .files import Files, settled

#: (1, 1) adds index commits, (1, 2) derived index tables.
FORMATS = ((1, 0), (1, 1), (1, 2))
#: Log rows whose ids may be broadcast; seconds that a lock is good for without being renewed.
BROADCAST_ROWS, LEASE_SECONDS = 200_000, 30.0
Reason = DurabilityError.Reason


def _locked(files: Files, path: str, owner: str) -> bool:
    """Take the lock of a store, also from an owner that stopped renewing it."""
    mine = {"owner": owner, "until": time.time() + LEASE_SECONDS}
    if files.create(f"{path}/LOCK", mine):
        return True
    try:
        held = files.read(f"{path}/LOCK")
    except Exception:  # noqa: BLE001  released, or written just now
        return False
    if held.get("until", 0) >= time.time() or not files.move(f"{path}/LOCK", f"{path}/LOCK.{held.get('owner')}"):
        return False
    files.delete(f"{path}/LOCK.{held.get('owner')}")
    return files.create(f"{path}/LOCK", mine)


def fingerprint(df: DataFrame) -> dict[str, int | str]:
    """Rows and an order-free sum of row hashes."""
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return {"rows": row["n"], "hash": str(row["h"])}


def merged(base: DataFrame, log: DataFrame, id_name: str) -> DataFrame:
    """The collection after the log. ``log`` has seq, pos, op (add, update, remove), doc_ord (of adds) and the fields;
    ``base`` the fields and doc_ord. One shuffle by id; of each id no more than its last row and its last order is kept on the way."""
    fields = [c for c in base.columns if c != ORD]
    old = base.select(F.lit(-1).cast("long").alias("seq"), F.lit(0).alias("pos"), F.lit("add").alias("op"), ORD, *fields)
    every = old.unionByName(log.select("seq", "pos", "op", ORD, *fields))
    last = every.groupBy(id_name).agg(F.max_by(F.struct("op", *[c for c in fields if c != id_name]), F.struct("seq", "pos")).alias("last"), F.max(ORD).alias(ORD))
    return last.where("last.op <> 'remove'").select(ORD, *[F.col(id_name) if c == id_name else F.col(f"last.`{c}`").alias(c) for c in fields])


@dataclass(frozen=True)
class MigrationPlan:
    source: str
    target: str
    digest: str
    rows: int


@dataclass(frozen=True)
class CleanupPlan:
    path: str
    digest: str
    files: tuple[str, ...]


@dataclass
class SnapshotStore:
    """One collection under ``path``. ``open_store`` makes or opens it."""

    spark: SparkSession
    path: str
    schema: SearchSchema
    manifest: dict
    owner: str = field(default_factory=lambda: uuid.uuid4().hex)
    codec: Codec = field(default_factory=Columns)
    own_tables: set[tuple[str, int]] = field(default_factory=set)
    _closed: threading.Event = field(default_factory=threading.Event)

    @property
    def files(self) -> Files:
        return Files(self.spark)

    # -- opening

    @classmethod
    def open_store(cls, spark: SparkSession, path: str, schema: SearchSchema, storage_format: tuple[int, int] = (1, 2), codec: Codec | None = None) -> SnapshotStore:
        files, codec = Files(spark), codec or Columns()
        if tuple(storage_format) not in FORMATS:
            raise DurabilityError(f"format {storage_format}", Reason.UNSUPPORTED_FORMAT)
        files.make(f"{path}/log")
        owner = uuid.uuid4().hex
        if not _locked(files, path, owner):
            raise DurabilityError(f"{path} is open elsewhere", Reason.STORAGE_IN_USE)
        try:
            if files.exists(f"{path}/MANIFEST.json"):
                manifest = read_manifest(files, path)
                if manifest["schema"] != json.loads(schema.struct.json()) or manifest["id"] != schema.id_field.name:
                    raise DurabilityError("the store has another schema", Reason.SCHEMA_MISMATCH)
                _check_codec(manifest, codec)
            else:
                manifest = {"format": list(storage_format), "history": uuid.uuid4().hex, "schema": json.loads(schema.struct.json()), "id": schema.id_field.name, "checkpoint": None, "seq": 0, "next_ord": 0, "indexes": {}, "codec": codec.name}
                files.create(f"{path}/MANIFEST.json", manifest)
            store = cls(spark, path, schema, manifest, owner, codec)
            store._recover()
            threading.Thread(target=store._stay, daemon=True).start()
            return store
        except Exception:
            files.delete(f"{path}/LOCK")
            raise

    def _recover(self) -> None:
        """Read the log's commits behind the checkpoint: their numbers must follow one another."""
        self.version, self.next_ord, self.indexes = self.manifest["seq"], self.manifest["next_ord"], dict(self.manifest["indexes"])
        self.sources: dict[str, int] = dict(self.manifest.get("sources", {}))  # the last batch of each stream
        self.log_rows: dict[int, int] = {}
        for name in self.commits():
            seq = int(name)
            if seq <= self.manifest["seq"]:
                continue
            if seq != self.version + 1:
                raise DurabilityError(f"commit {self.version + 1} is missing", Reason.CORRUPT_LOG)
            meta = self.files.read(f"{self.path}/log/{name}/META.json")
            self.version, self.next_ord = seq, meta["next_ord"]
            self.log_rows[seq] = meta.get("rows", 0)
            self._applied(meta)
            if meta["kind"] == "INDEX_CREATE":
                self.indexes[meta["index"]] = meta["at"]
            elif meta["kind"] == "INDEX_DROP":
                self.indexes.pop(meta["index"], None)

    def _applied(self, meta: dict) -> None:
        if "source" in meta:
            self.sources[meta["source"]] = max(self.sources.get(meta["source"], -1), meta["batch"])

    def commits(self) -> list[str]:
        return [n for n in self.files.list(f"{self.path}/log") if n.isdigit()]

    def _stay(self) -> None:
        """Renew the lock's lease until it is closed: it ends with its owner."""
        while not self._closed.wait(LEASE_SECONDS / 3):
            try:
                self.files.replace(f"{self.path}/LOCK", {"owner": self.owner, "until": time.time() + LEASE_SECONDS})
            except Exception:  # noqa: BLE001  the session or the folder is gone; so the lease ends
                return

    def close(self) -> None:
        self._closed.set()
        self.files.delete(f"{self.path}/LOCK")

    # -- reading

    @property
    def log_schema(self) -> T.StructType:
        return T.StructType([T.StructField("seq", T.LongType()), T.StructField("pos", T.IntegerType()), T.StructField("op", T.StringType()), T.StructField(ORD, T.LongType()), *[T.StructField(f.name, f.dataType) for f in self.schema.struct.fields]])

    def base(self) -> DataFrame:
        if self.manifest["checkpoint"] is None:
            return self.spark.createDataFrame([], T.StructType([T.StructField(ORD, T.LongType()), *[T.StructField(f.name, f.dataType) for f in self.schema.struct.fields]]))
        return self._read(self.spark.read.parquet(f"{self.path}/checkpoint/{self.manifest['checkpoint']}/data"))

    def _read(self, df: DataFrame) -> DataFrame:
        return self.codec.read(df, self.schema.struct, self.schema.id_field.name)

    def _written(self, df: DataFrame) -> DataFrame:
        return self.codec.written(df, self.schema.struct, self.schema.id_field.name)

    @property
    def stored_log(self) -> T.StructType:
        return self.codec.stored(self.log_schema, self.schema.struct, self.schema.id_field.name)

    def log(self, upto: int | None = None) -> DataFrame:
        names = [n for n in self.commits() if self.manifest["seq"] < int(n) <= (upto if upto is not None else self.version)]
        folders = [f"{self.path}/log/{n}/rows" for n in names if self.files.exists(f"{self.path}/log/{n}/rows")]
        return self._read(self.spark.read.schema(self.stored_log).parquet(*folders)) if folders else self.spark.createDataFrame([], self.log_schema)

    def at(self, version: int | None = None) -> DataFrame:
        """The collection at a version from the checkpoint's on, the latest by default.

        The checkpoint but for the ids that the log names, and what becomes of these. While the log's rows, by its
        commits' own counts, are few, their ids are broadcast and the checkpoint isn't shuffled."""
        upto = self.version if version is None else version
        rows = sum(n for seq, n in list(self.log_rows.items()) if self.manifest["seq"] < seq <= upto)
        if rows == 0:
            return self.base()
        base, log, name = self.base(), self.log(upto), self.schema.id_field.name
        touched = log.select(F.col(name).alias("_id")).distinct()
        if rows <= BROADCAST_ROWS:
            touched = F.broadcast(touched)
        same = F.col(name) == F.col("_id")
        changed = merged(base.join(touched, same, "left_semi"), log, name)
        return base.join(touched, same, "left_anti").unionByName(changed)

    def having(self, ids: DataFrame) -> DataFrame:
        """The documents of a few ids (a column ``_key``), found before the log is merged."""
        name = self.schema.id_field.name
        same = F.col(name) == F.col("_key")
        return merged(self.base().join(ids, same, "left_semi"), self.log().join(ids, same, "left_semi"), name)

    # -- writing

    def commit(self, rows: DataFrame | None, kind: str = "BULK", adds: int = 0, **meta) -> int:
        """Append one commit; visible at once, when its folder has its name. Returns its sequence number."""
        seq, tmp = self.version + 1, f"{self.path}/log/_new-{uuid.uuid4().hex}"
        if rows is not None:
            self._written(rows.withColumn("seq", F.lit(seq).cast("long")).select(*self.log_schema.names)).write.parquet(f"{tmp}/rows")
            meta |= fingerprint(self.spark.read.schema(self.stored_log).parquet(f"{tmp}/rows"))
        self.files.make(tmp)
        self.files.create(f"{tmp}/META.json", {"seq": seq, "kind": kind, "next_ord": self.next_ord + adds, **meta})
        if not self.files.move(tmp, f"{self.path}/log/{seq:012d}"):
            raise DurabilityError(f"commit {seq} is there already: another writer", Reason.STORAGE_IN_USE)
        self.version, self.next_ord = seq, self.next_ord + adds
        self.log_rows[seq] = int(meta.get("rows", 0))
        self._applied(meta)
        return seq

    def checkpoint(self) -> int:
        """Write the merged collection and point the manifest at it."""
        target = f"{self.path}/checkpoint/{self.version:012d}"
        if self.manifest["checkpoint"] == f"{self.version:012d}":
            return self.version
        self.files.delete(target)
        self._written(self.at()).write.parquet(f"{target}/data")
        mark = fingerprint(self.spark.read.parquet(f"{target}/data"))
        self.manifest = self.manifest | {"checkpoint": f"{self.version:012d}", "seq": self.version, "next_ord": self.next_ord, "indexes": self.indexes, "sources": self.sources, "mark": mark}
        self.files.replace(f"{self.path}/MANIFEST.json", self.manifest)
        return self.version

    # -- backups

    def backup(self, target: str) -> dict:
        """A bundle of the collection at a checkpoint, with a manifest that names its digest."""
        if self.files.exists(target):
            raise DurabilityError(f"{target} exists", Reason.TARGET_EXISTS)
        self.checkpoint()
        self.files.make(target)
        self.files.copy(f"{self.path}/checkpoint/{self.manifest['checkpoint']}", f"{target}/checkpoint")
        bundle = {k: self.manifest[k] for k in ("format", "history", "schema", "id", "seq", "next_ord", "mark")} | {"kind": "backup", "codec": self.codec.name}
        bundle["digest"] = _digest(bundle)
        self.files.create(f"{target}/BACKUP.json", bundle)
        return bundle

    # -- derived index tables

    def derived(self, name: str, d: index_ops.IndexDefinition) -> tuple[str, DataFrame | None, str]:
        """The newest table of an index that the log behind it still completes (``warm``), with the ids changed since; or one of
        the present version, ``merged`` from an older one and the log's commits since, or ``rebuilt`` where these are gone."""
        made = [int(v) for v in self._tables(name) if int(v) <= self.version]
        if made and made[-1] >= self.manifest["seq"]:
            return self._table(name, made[-1]), self._since(made[-1], self.version), "warm"
        return self.build_derived(name, d, self.version), None, "merged" if made and self._since(made[-1], self.version) is not None else "rebuilt"

    def build_derived(self, name: str, d: index_ops.IndexDefinition, version: int) -> str:
        """Write an index's table as of a version. Others may commit meanwhile: what changes later completes it when it is read."""
        path, key = self._table(name, version), self.schema.id_field.column
        self.files.delete(path)
        made = [int(v) for v in self._tables(name) if int(v) < version]
        changed = self._since(made[-1], version) if made else None
        if changed is not None:
            index_ops.merge(self._table(name, made[-1]), self.at(version), settled(changed), d, path, key)
        else:
            index_ops.build(self.at(version), d, path, key)
        self.files.create(f"{path}/DONE.json", {"history": self.manifest["history"], "version": version})
        self.own_tables.add((name, version))
        return path

    def _table(self, name: str, version: int) -> str:
        return f"{self.path}/derived/{name.replace(':', '-')}/{version:012d}"

    def _tables(self, name: str) -> list[str]:
        """The versions of an index's tables that are whole and of this history."""
        folder, history = f"{self.path}/derived/{name.replace(':', '-')}", self.manifest["history"]
        if tuple(self.manifest["format"]) < (1, 2):  # tables of an earlier session don't count
            return [v for v in self.files.list(folder) if self.files.exists(f"{folder}/{v}/DONE.json") and (name, int(v)) in self.own_tables]
        return [v for v in self.files.list(folder) if self.files.exists(f"{folder}/{v}/DONE.json") and self.files.read(f"{folder}/{v}/DONE.json") == {"history": history, "version": int(v)}]

    def _since(self, at: int, upto: int) -> DataFrame | None:
        """The ids (``_key``) that commits behind ``at`` name; None where there are none, or a commit is gone."""
        names = [n for n in self.commits() if at < int(n) <= upto]
        folders = [f"{self.path}/log/{n}/rows" for n in names if self.files.exists(f"{self.path}/log/{n}/rows")]
        if len(names) < upto - at or not folders:
            return None
        return self.spark.read.schema(self.stored_log).parquet(*folders).select(F.col(self.schema.id_field.name).alias("_key")).distinct()


def _digest(value: dict) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def read_manifest(files: Files, path: str, name: str = "MANIFEST.json") -> dict:
    try:
        manifest = files.read(f"{path}/{name}")
    except ValueError as e:
        raise DurabilityError(f"{path}/{name}: {e}", Reason.CORRUPT_MANIFEST) from e
    if tuple(manifest.get("format", ())) not in FORMATS:
        raise DurabilityError(f"format {manifest.get('format')}", Reason.UNSUPPORTED_FORMAT)
    return manifest


def inspect_format(spark: SparkSession, path: str) -> dict:
    """Format, history and position of a store or a backup, from its manifest alone."""
    files = Files(spark)
    name = "BACKUP.json" if files.exists(f"{path}/BACKUP.json") else "MANIFEST.json"
    m = read_manifest(files, path, name)
    return {"kind": m.get("kind", "store"), "format": tuple(m["format"]), "history": m["history"], "seq": m["seq"], "id": m["id"]}


def inspect_derived(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    files = Files(spark)
    return [(n, int(v)) for n in files.list(f"{path}/derived") for v in files.list(f"{path}/derived/{n}") if files.exists(f"{path}/derived/{n}/{v}/DONE.json")]


def _check_data(spark: SparkSession, folder: str, mark: dict, reason) -> None:
    if not Files(spark).exists(folder):
        raise DurabilityError(folder, Reason.MISSING_FILE)
    try:
        found = fingerprint(spark.read.parquet(folder))
    except DurabilityError:
        raise
    except Exception as e:
        raise DurabilityError(f"{folder}: {str(e)[:200]}", reason) from e
    if found != {"rows": mark["rows"], "hash": mark["hash"]}:
        raise DurabilityError(f"{folder} has {found}, not {mark}", reason)


def verify_store(spark: SparkSession, path: str) -> dict:
    """Structure: the manifest, the checkpoint's rows and hash, and those of each later commit, without a gap."""
    files = Files(spark)
    m = read_manifest(files, path)
    if m["checkpoint"] is not None:
        _check_data(spark, f"{path}/checkpoint/{m['checkpoint']}/data", m["mark"], Reason.CORRUPT_CHECKPOINT)
    expected = m["seq"]
    for name in files.list(f"{path}/log"):
        if name.isdigit() and int(name) > m["seq"]:
            expected += 1
            if int(name) != expected:
                raise DurabilityError(f"commit {expected} is missing", Reason.CORRUPT_LOG)
            meta = files.read(f"{path}/log/{name}/META.json")
            if "rows" in meta:
                _check_data(spark, f"{path}/log/{name}/rows", meta, Reason.CORRUPT_LOG)
    return {"seq": expected, "checkpoint": m["checkpoint"]}


def verify_backup(spark: SparkSession, path: str, schema: SearchSchema | None = None) -> dict:
    """Structure; with a schema also meaning: the schema's types, ids that are there once, one order each."""
    m = read_manifest(Files(spark), path, "BACKUP.json")
    if _digest({k: v for k, v in m.items() if k != "digest"}) != m["digest"]:
        raise DurabilityError("the manifest's digest is another", Reason.CORRUPT_MANIFEST)
    _check_data(spark, f"{path}/checkpoint/data", m["mark"], Reason.CORRUPT_CHECKPOINT)
    if schema is not None:
        df = spark.read.parquet(f"{path}/checkpoint/data")
        if json.loads(schema.struct.json()) != m["schema"]:
            raise DurabilityError("the backup has another schema", Reason.SCHEMA_MISMATCH)
        row = df.agg(F.count("*"), F.count_distinct(schema.id_field.column), F.count_distinct(ORD)).first()
        if len(set(row)) > 1:
            raise DurabilityError(f"rows, ids and orders are {tuple(row)}", Reason.DUPLICATE_KEY)
    return m


def restore_backup(spark: SparkSession, backup: str, target: str) -> dict:
    """A new store, with a history of its own, in a folder that isn't there yet."""
    files = Files(spark)
    if files.exists(target):
        raise DurabilityError(f"{target} exists", Reason.TARGET_EXISTS)
    m = verify_backup(spark, backup)
    tmp = f"{target}.new-{uuid.uuid4().hex}"
    name = f"{m['seq']:012d}"
    files.make(f"{tmp}/log")
    files.make(f"{tmp}/checkpoint")
    files.copy(f"{backup}/checkpoint", f"{tmp}/checkpoint/{name}")
    manifest = {k: m[k] for k in ("format", "schema", "id", "seq", "next_ord", "mark")} | {"history": uuid.uuid4().hex, "checkpoint": name, "indexes": {}, "codec": m.get("codec", "columns")}
    files.create(f"{tmp}/MANIFEST.json", manifest)
    files.move(tmp, target)
    return manifest


def read_backup(spark: SparkSession, path: str, codec: Codec | None = None) -> DataFrame:
    """The collection in a backup, for other uses."""
    m, codec = verify_backup(spark, path), codec or Columns()
    _check_codec(m, codec)
    return codec.read(spark.read.parquet(f"{path}/checkpoint/data"), T.StructType.fromJson(m["schema"]), m["id"])


def _check_codec(manifest: dict, codec: Codec) -> None:
    if manifest.get("codec", "columns") != codec.name:
        raise DurabilityError(f"written by the codec {manifest.get('codec', 'columns')!r}, not {codec.name!r}", Reason.SCHEMA_MISMATCH)


def write_backup(df: DataFrame, path: str, schema: SearchSchema) -> dict:
    """A backup from a table: ids in their order become the natural order."""
    spark, files = df.sparkSession, Files(df.sparkSession)
    if files.exists(path):
        raise DurabilityError(f"{path} exists", Reason.TARGET_EXISTS)
    rows = numbered(df.select(*schema.struct.names), schema.id_field.name) if ORD not in df.columns else df.select(ORD, *schema.struct.names)
    rows.write.parquet(f"{path}/checkpoint/data")
    data = spark.read.parquet(f"{path}/checkpoint/data")
    n = data.agg(F.max(ORD)).first()[0]
    bundle = {"format": [1, 2], "history": uuid.uuid4().hex, "schema": json.loads(schema.struct.json()), "id": schema.id_field.name, "seq": 0, "next_ord": 0 if n is None else n + 1, "mark": fingerprint(data), "kind": "backup"}
    bundle["digest"] = _digest(bundle)
    files.create(f"{path}/BACKUP.json", bundle)
    return bundle


def numbered(df: DataFrame, id_name: str) -> DataFrame:
    """``doc_ord`` from 0 by id: sorted by range, counted per partition, then numbered in each: no single task sorts it all.
    The ranges come from a sample that another run would draw anew, so they are settled first."""
    spread = settled(df.repartitionByRange(F.col(id_name)).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r[0], r[1]) for r in spread.groupBy("_part").count().collect())  # a row per partition
    start, at = {}, 0
    for part, n in counts:
        start[part], at = at, at + n
    offsets = F.element_at(F.create_map(*[x for k, v in start.items() for x in (F.lit(k), F.lit(v).cast("long"))]), F.col("_part")) if start else F.lit(0)
    w = Window.partitionBy("_part").orderBy(id_name)
    return spread.withColumn(ORD, (F.row_number().over(w) - 1).cast("long") + offsets).drop("_part").select(ORD, *df.columns)


# -- migration


def plan_migration(spark: SparkSession, backup: str, target: str, transform: Callable[[DataFrame], DataFrame], schema: SearchSchema) -> MigrationPlan:
    """Check a one-to-one transform of a backup to another schema, and bind it by a digest to what was checked."""
    m = verify_backup(spark, backup)
    if Files(spark).exists(target):
        raise DurabilityError(f"{target} exists", Reason.TARGET_EXISTS)
    out = _migrated(spark, backup, transform, schema)
    row = out.agg(F.count("*").alias("n"), F.count_distinct(schema.id_field.column).alias("ids")).first()
    if row["n"] != m["mark"]["rows"] or row["ids"] != row["n"]:
        raise DurabilityError(f"{m['mark']['rows']} rows become {row['n']} with {row['ids']} ids", Reason.DUPLICATE_KEY)
    return MigrationPlan(backup, target, _digest({"source": m["digest"], "target": target, "schema": schema.struct.json(), "result": fingerprint(out)}), row["n"])


def _migrated(spark: SparkSession, backup: str, transform: Callable[[DataFrame], DataFrame], schema: SearchSchema) -> DataFrame:
    """The transform sees doc_ord and must keep it."""
    return transform(read_backup(spark, backup)).select(ORD, *schema.struct.names)


def apply_migration(spark: SparkSession, plan: MigrationPlan, transform: Callable[[DataFrame], DataFrame], schema: SearchSchema) -> dict:
    if plan_migration(spark, plan.source, plan.target, transform, schema) != plan:
        raise DurabilityError("source, transform or schema changed since the plan", Reason.PLAN_MISMATCH)
    return write_backup(_migrated(spark, plan.source, transform, schema), plan.target, schema)


# -- cleanup


def plan_cleanup(spark: SparkSession, path: str) -> CleanupPlan:
    """Files that nothing refers to: unfinished commits, commits and checkpoints behind the manifest's, derived tables of other versions."""
    files = Files(spark)
    m = read_manifest(files, path)
    log = [n for n in files.list(f"{path}/log") if n.isdigit()]
    last = max([m["seq"], *map(int, log)])
    gone = [f"log/{n}" for n in files.list(f"{path}/log") if n.startswith("_new-") or (n.isdigit() and int(n) <= m["seq"])]
    gone += [f"checkpoint/{n}" for n in files.list(f"{path}/checkpoint") if n != m["checkpoint"]]
    for n in files.list(f"{path}/derived"):
        versions = [v for v in files.list(f"{path}/derived/{n}") if m["seq"] <= int(v) <= last and files.exists(f"{path}/derived/{n}/{v}/DONE.json")]
        gone += [f"derived/{n}/{v}" for v in files.list(f"{path}/derived/{n}") if v not in versions[-1:]]
    return CleanupPlan(path, _digest({"files": gone, "manifest": m}), tuple(gone))


def apply_cleanup(spark: SparkSession, plan: CleanupPlan) -> Sequence[str]:
    if plan_cleanup(spark, plan.path) != plan:
        raise DurabilityError("the store changed since the plan", Reason.PLAN_MISMATCH)
    for f in plan.files:
        Files(spark).delete(f"{plan.path}/{f}")
    return plan.files
