"""Near-duplicate vectors by NN-descent.

A graph of each vector's nearest neighbours under its label begins with the neighbours that random hyperplanes put
together, in as many tables as each label's size asks for (a small label is compared whole), and is refined by joining neighbours of neighbours: around every vector, its neighbours (both ways) are compared
with each other and offered to each other's lists. Lists hold ``K``. A list that is full of links, saturated, is too
short: it is enlarged to the whole pool that the links found so far connect it to, compared in blocks without
emitting the pairs. Only a link between two saturated vectors can be cut from both lists, so the saturated vectors of a label are
also compared across pools, all of them, and pools with a link between them become one. Recall is audited on uniformly drawn vectors against all others, each that has links counting the same,
and more tables with longer lists follow while it is short, until every label is compared whole. Links are checked in double precision; edges under the threshold are dropped.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ann import usable
from .shared import components, cut, mix64, small

#: Neighbours in a list; vectors of a bucket, about; the chance that no table puts a pair at the threshold together.
K, BUCKET, MISS = 8, 48, 0.001
#: Labels of so many vectors are compared whole; vectors of a part of a bucket that holds more than two parts' worth.
WHOLE, PART = 2048, 2048
#: The share of list entries that a round must still change for another.
LEAST_CHANGE = 0.01
#: Vectors audited at first and at most, more of them until so many have links, and the recall of their links that is enough.
AUDIT, MOST_AUDIT, LINKED, LEAST_RECALL = 200, 12_800, 100, 0.995
#: Vectors of a block when a pool is compared.
BLOCK = 512

PAIR = "u long, v long, sim double"


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row."""
    return (a * b).sum(-1) / np.sqrt((a * a).sum(-1) * (b * b).sum(-1))


def _read(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, _ = usable(batch.column("embedding"), dim)
            ok &= pc.is_valid(batch.column("vec_id")).to_numpy(zero_copy_only=False) & pc.is_valid(batch.column("label")).to_numpy(zero_copy_only=False)
            some = batch.filter(pa.array(ok))
            if some.num_rows:
                _, x = usable(some.column("embedding"), dim)
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array([v.tobytes() for v in x], pa.binary())], names=["vec_id", "label", "vector"])

    return run


def tables_for(size: int, threshold: float, more: float = 1.0) -> tuple[int, int]:
    """Hyperplanes of a table, and tables, for a label of ``size`` vectors; no hyperplane where comparing all is as cheap."""
    if size <= WHOLE:
        return 0, 1
    bits = max(1, int(np.log2(size / BUCKET)))
    together = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    if together >= 1:
        return bits, 1
    tables = more * np.log(MISS) / np.log1p(-together) if together > 0 else np.inf
    return (0, 1) if tables * BUCKET >= size else (bits, int(np.ceil(tables)))


def _buckets(threshold: float, more: float, seed: int):
    """(bucket, id, vector) for each table of the label: the signs at its hyperplanes, with the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"))
            label = np.array([xxhash.xxh64_intdigest(v) for v in batch.column("label").to_pylist()], np.uint64)
            sizes, at = np.unique(batch.column("size").to_numpy(), return_inverse=True)
            plans = [tables_for(int(size), threshold, more) for size in sizes]
            for bits, tables in sorted(set(plans)):
                own = np.flatnonzero(np.array([plan == (bits, tables) for plan in plans])[at])
                rows = batch.take(pa.array(own))
                for t in range(tables):
                    planes = np.random.default_rng([seed, t]).standard_normal((bits, x.shape[1]))
                    code = ((x[own] @ planes.T) > 0) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
                    key = mix64(label[own] + mix64(code.astype(np.uint64) + mix64(np.array([t + 1], np.uint64))))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), rows.column("id"), rows.column("vector")], names=["hub", "id", "vector"])

    return run


def _by_part(group: Callable, names: list[str]) -> Callable:
    """``group`` for the columns (a dict of arrays) of each (hub, part), of rows in their order; its arrays in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def flush(table: pa.Table, upto: int) -> Iterator[pa.RecordBatch]:
            columns = {c: (_matrix(table.column(c).combine_chunks()) if c == "vector" else table.column(c).to_numpy())[:upto] for c in table.column_names}
            edges = np.flatnonzero((np.diff(columns["hub"]) != 0) | (np.diff(columns["part"]) != 0)) + 1
            found = [group({c: x[a:b] for c, x in columns.items()}) for a, b in zip([0, *edges], [*edges, upto], strict=True) if b - a > 1]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(len(names))], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            hub, part = held.column("hub").to_numpy(), held.column("part").to_numpy()
            edges = np.flatnonzero((np.diff(hub) != 0) | (np.diff(part) != 0)) + 1
            if len(edges):
                yield from flush(held, int(edges[-1]))
                held = held.slice(int(edges[-1])).combine_chunks()
        if held is not None:
            yield from flush(held, held.num_rows)

    return run


def _offer(most: int, k: int, threshold: float) -> Callable:
    """Rows (hub, part, id, vector), those of one hub and part together: compare them all, and offer each the ``most``
    nearest, and up to ``k`` that are links."""

    def group(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, at = np.unique(ids, return_index=True)
        x = x[at]
        y = x / np.sqrt((x * x).sum(1, keepdims=True))
        wide = min(k, len(ids) - 1)
        if wide < 1:
            return ids[:0], ids[:0], np.zeros(0)
        found = []
        for a in range(0, len(ids), 256):
            s = y[a : a + 256] @ y.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
            best = np.argpartition(-s, wide - 1, axis=1)[:, :wide]
            sim = np.take_along_axis(s, best, 1)
            order = np.argsort(-sim, axis=1, kind="stable")
            best, sim = np.take_along_axis(best, order, 1), np.take_along_axis(sim, order, 1)
            i, j = np.nonzero((np.arange(wide) < most) | (sim >= threshold - 1e-6))
            found.append((ids[a + i], ids[best[i, j]], sim[i, j]))
        u, v, sim = (np.concatenate([f[c] for f in found]) for c in range(3))
        return u, v, sim

    return _by_part(lambda rows: group(rows["id"], rows["vector"]), ["u", "v", "sim"])


def _offers(rows: DataFrame, most: int, k: int, threshold: float) -> DataFrame:
    """rows: (hub, part, id, vector)"""
    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part").mapInArrow(_offer(most, k, threshold), PAIR)


def _dealt(start: DataFrame) -> DataFrame:
    """Buckets (hub, id, vector, ...) with a part: a bucket of more than two parts' worth is cut by a hash, and every two of
    its cuts make a part, so that each pair of its vectors meets."""
    crowded = start.groupBy("hub").agg(F.ceil(F.count("*") / PART).cast("long").alias("cuts")).where("cuts > 2")
    own = F.pmod(F.xxhash64("id", "hub"), F.col("cuts"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1), lambda j: j != F.col("own"))
    parts = F.transform(others, lambda j: F.least("own", j) * F.col("cuts") + F.greatest("own", j))
    some = start.join(small(cut(crowded)), "hub", "left").withColumn("own", own)
    return some.select("hub", F.explode(F.coalesce(parts, F.array(F.lit(0).cast("long")))).alias("part"), *[c for c in start.columns if c != "hub"])


def _nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each u, distinct."""
    one = pairs.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))).where(F.col("rank") <= k)


def _exact(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = cosines(_matrix(batch.column("a")), _matrix(batch.column("b")))
                yield batch.select(["u", "v"]).filter(pa.array(s >= threshold))

    return run


def _pool(threshold: float) -> Callable:
    """A block pair of a pool: how many (weighted) links each vector of side 0 has to side 1."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, n, x = table.column("id").to_numpy(), table.column("n").to_numpy(), _matrix(table.column("vector").combine_chunks())
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        y = x / np.sqrt((x * x).sum(1, keepdims=True))
        count = np.zeros(len(a), np.int64)
        s = y[a] @ y[b].T
        near = s >= threshold
        i, j = np.nonzero(np.abs(s - threshold) < 1e-9)  # so near that the order of sums matters
        if len(i):
            near[i, j] = cosines(x[a[i]], x[b[j]]) >= threshold
        near &= ids[a][:, None] != ids[b][None, :]
        count = near @ n[b]
        return pa.table({"id": pa.array(ids[a]), "links": pa.array(count.astype(np.int64))})

    return run


def _bridge(threshold: float) -> Callable:
    """Rows (hub, part, id, vector, component): the pairs of components of a part with a link between them."""

    def group(rows: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(rows["component"], kind="stable")
        comp, x = rows["component"][order], rows["vector"][order]
        y = x / np.sqrt((x * x).sum(1, keepdims=True))
        found = [np.zeros((0, 2), np.int64)]
        for a in range(0, len(comp), 256):
            behind = int(np.searchsorted(comp, comp[a], "right"))
            if behind == len(comp):
                break
            s = y[a : a + 256] @ y[behind:].T
            near = s >= threshold
            i, j = np.nonzero(np.abs(s - threshold) < 1e-9)  # so near that the order of sums matters
            if len(i):
                near[i, j] = cosines(x[a + i], x[behind + j]) >= threshold
            i, j = np.nonzero(near & (comp[a : a + 256, None] < comp[None, behind:]))
            found.append(np.unique(np.stack([comp[a + i], comp[behind + j]], 1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]

    return _by_part(group, ["u", "v"])


def _joined(nodes: DataFrame, comps: DataFrame, full: DataFrame, threshold: float, rows: int) -> DataFrame:
    """``comps`` (id, component), components with a link between saturated vectors (``full``) made one: every two such
    vectors of a label in different components are compared."""
    own = cut(comps.join(full, "id").join(nodes.select("id", "label"), "id"), rows)
    several = cut(own.groupBy("label").agg(F.countDistinct("component").alias("n")).where("n > 1").select("label"), rows)
    if several.isEmpty():
        return comps
    some = own.join(small(several), "label").join(nodes.select("id", "vector"), "id").select(F.xxhash64("label").alias("hub"), "id", "vector", "component")
    dealt = _dealt(some).repartition("hub", "part").sortWithinPartitions("hub", "part")
    pairs = cut(dealt.mapInArrow(_bridge(threshold), "u long, v long").distinct())
    n = pairs.count()
    if n == 0:
        return comps
    to = components(pairs, n).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return cut(comps.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component")), rows)


def _audit(threshold: float, sample: list[tuple[int, str, bytes]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, labels = np.array([s[0] for s in sample]), np.stack([np.frombuffer(s[2]) for s in sample]), {}
        for i, s in enumerate(sample):
            labels.setdefault(s[1], []).append(i)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"))
            own, n = batch.column("id").to_numpy(), batch.column("n").to_numpy()
            label, links = np.array(batch.column("label").to_pylist()), np.zeros(len(ids), np.int64)
            for name in set(label.tolist()) & set(labels):
                b = np.flatnonzero(label == name)
                for c in range(0, len(labels[name]), 256):
                    a = np.array(labels[name][c : c + 256])
                    norm = np.sqrt((q[a] * q[a]).sum(1))[:, None] * np.sqrt((x[b] * x[b]).sum(1))[None, :]
                    links[a] = (((q[a] @ x[b].T) / norm >= threshold) & (ids[a][:, None] != own[b][None, :])) @ n[b]
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some])], names=["id", "links"])

    return run


def _truth(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, true): the links of uniformly drawn vectors that have any, counted by brute force."""
    size = AUDIT
    while True:
        sample = [(r[0], r[1], bytes(r[2])) for r in nodes.orderBy(F.xxhash64("id")).limit(size).select("id", "label", "vector").collect()]
        true = cut(nodes.mapInArrow(_audit(threshold, sample), "id long, links long").groupBy("id").agg(F.sum("links").alias("true")))
        if size >= min(n, MOST_AUDIT) or true.count() >= LINKED:
            return true
        size *= 4


def _recall(true: DataFrame, found: DataFrame) -> float:
    """The share of its links that was found, on average over the vectors of ``true``."""
    share = F.least("true", F.coalesce("links", F.lit(0))) / F.col("true")
    recall = true.join(found.select("id", "links"), "id", "left").agg(F.avg(share)).first()[0]
    return 1.0 if recall is None else recall


def _links(nodes: DataFrame, lists: DataFrame, k: int, threshold: float, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, links, component) of nodes that have links; from the lists, and for saturated ones from their pools. Also the saturated ones, with those of
    shorter lists ``before``: what these lists cut stays cut when they grow."""
    near = lists.where(F.col("sim") >= threshold - 1e-6).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    vec = nodes.select("id", "vector")
    most = lists.count()
    edges = cut(near.join(vec.withColumnsRenamed({"id": "u", "vector": "a"}), "u").join(vec.withColumnsRenamed({"id": "v", "vector": "b"}), "v").select("u", "v", "a", "b").mapInArrow(_exact(threshold), "u long, v long"), most)
    comps = cut(components(edges, most).withColumnRenamed("node", "id"), 2 * most)
    full = lists.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("least")).where((F.col("n") >= k) & (F.col("least") >= threshold - 1e-6)).select(F.col("u").alias("id"))
    full = cut(full if before is None else full.unionByName(before).distinct(), most)
    comps = _joined(nodes, comps, full, threshold, 2 * most)
    pools = cut(comps.join(full, "id").select("component").distinct(), most)
    pooled = comps.join(pools, "component")
    sizes = pooled.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    member = pooled.join(sizes, "component").join(nodes.select("id", "n", "vector"), "id").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    to = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    left = member.select("component", "id", "n", "vector", F.col("own").alias("i"), F.explode(to).alias("j"), F.lit(0).alias("side"))
    right = member.select("component", "id", "n", "vector", F.explode(to).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"))
    dense = left.unionByName(right).groupBy("component", "i", "j").applyInArrow(_pool(threshold), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    loose = comps.join(pools, "component", "left_anti").select("id")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(loose.withColumnRenamed("id", "u"), "u", "left_semi")
    sparse = both.join(nodes.select(F.col("id").alias("v"), "n"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("n").alias("links"))
    return cut(dense.unionByName(sparse).join(comps, "id"), 2 * most), full


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, k: int = K) -> DataFrame:
    """One row per row of ``vectors (vec_id long, embedding array, label, ...)``: vec_id, n_links (other vectors with equal
    label and cosine at or above ``threshold``), component_id (smallest vec_id reachable by links), kept, audit_recall.

    Null ids, null labels, and vectors that are null, zero, of another length than most (of two as frequent the shorter) or hold null or
    non-finite components link with nothing: n_links 0, component_id their own id, kept (also with a null id). Equal vectors of
    one label are one class, whose members all count. Rows that repeat a vec_id count as one vector each in n_links, a row's
    own aside. An empty table gives no rows. Further columns are ignored. audit_recall is the share of its
    links, counted by brute force, that was found, on average over uniformly drawn vectors that have links.
    """
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    first = vectors.where("embedding IS NOT NULL AND size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = first[0] if first else 0
    rows = cut(vectors.mapInArrow(_read(dim), "vec_id long, label string, vector binary"))
    n_rows = rows.count()
    classes = cut(rows.groupBy("label", F.sha2("vector", 256).alias("sha")).agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector")), n_rows)
    # A repeated id under several labels or vectors would be several nodes of one name: each class gets a name of its own.
    nodes = classes.select(F.xxhash64("label", "sha").alias("id"), "label", "n", "vector")
    n = nodes.count()
    all_rows = vectors.select("vec_id")
    if n == 0:
        return all_rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(1.0).alias("audit_recall"))
    sizes = cut(nodes.groupBy("label").agg(F.count("*").alias("size")), n)
    sized = cut(nodes.select("id", "label", "vector").join(small(sizes), "label"), n)
    true = _truth(nodes, n, threshold)
    lists = full = None
    for attempt in itertools.count():
        more = 2.0**attempt  # so many times the tables; in the end every label is compared whole
        start = sized.mapInArrow(_buckets(threshold, more, attempt), "hub long, id long, vector binary")
        offers = _offers(_dealt(start), k, k, threshold)
        lists = cut(_nearest(offers if lists is None else offers.unionByName(lists.select("u", "v", "sim")), k), n * k)
        while True:
            back = lists.select(F.col("v").alias("hub"), F.col("u").alias("id"), "sim").withColumn("rank", F.row_number().over(Window.partitionBy("hub").orderBy(F.desc("sim"), "id"))).where(F.col("rank") <= k).select("hub", "id")
            around = lists.select(F.col("u").alias("hub"), F.col("v").alias("id")).unionByName(back).unionByName(nodes.select(F.col("id").alias("hub"), "id")).distinct()
            hubs = around.join(nodes.select("id", "vector"), "id").select("hub", F.lit(0).cast("long").alias("part"), "id", "vector")
            new = cut(_nearest(_offers(hubs, max(2, k // 2), k, threshold).unionByName(lists.select("u", "v", "sim")), k), n * k)
            changed = new.join(lists.select("u", "v"), ["u", "v"], "left_anti").count()
            lists = new
            if changed <= LEAST_CHANGE * n * k:
                break
        found, full = _links(nodes, lists, k, threshold, full)
        recall = _recall(true, found)
        if recall >= LEAST_RECALL or all(tables_for(r["size"], threshold, more)[0] == 0 for r in sizes.select("size").distinct().collect()):
            break
        k = 2 * k
    own = classes.select("label", "sha", F.xxhash64("label", "sha").alias("_node"), "id", "n")
    named = own.join(found.withColumnRenamed("id", "_node"), "_node", "left")
    smallest = named.groupBy(F.coalesce("component", "_node").alias("c")).agg(F.min("id").alias("component_id"))
    named = named.withColumn("c", F.coalesce("component", "_node")).join(smallest, "c").select("label", "sha", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = rows.select("vec_id", "label", F.sha2("vector", 256).alias("sha")).join(named, ["label", "sha"]).select("vec_id", "n_links", "component_id")
    ok = rows.select(F.col("vec_id").alias("_id"))
    alone = all_rows.join(ok.distinct(), F.col("vec_id") == F.col("_id"), "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.lit(recall).alias("audit_recall"))
