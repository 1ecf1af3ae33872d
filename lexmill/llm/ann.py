"""Approximate nearest neighbours by largest inner product: an inverted file of coarse centroids with
product-quantised residuals, asymmetric distance tables and exact reranking.

Centroids, in two levels, and codebooks are fitted on a bounded sample; every row is indexed. The number of lists grows with the table, so
that a list stays of one size. Neighbouring lists are put together into cells of a bounded number of vectors (a longer list is dealt over
several); queries go to the cells of the lists they probe, and nowhere else. In a cell the tables rank the vectors of the lists that a
query probes, and the best are reranked exactly.

How many lists a query probes is set from the sample, by comparison with an exact search in it, and then audited: some queries are compared with
all rows, and while too few of their neighbours were found, all queries probe twice as many. A query that finds fewer than it could probes all lists.

Equal vectors are one candidate of several ids, of which the smallest suffice, and one query, whose result each of its ids gets: a
vector with very many copies is no hot group.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Vectors that centroids and codebooks are fitted on: at least, so far as there are as many, and for each list.
SAMPLE, PER_LIST = 16_000, 16
#: Vectors of a list, about; lists at most (their sample is what the driver holds); subspaces, codes in each.
LIST, LISTS, SUBSPACES, CODES = 512, 16_384, 16, 256
#: Vectors of a cell, queries of a block; vectors first reranked per query and cell for each neighbour asked for, and the
#: standard deviations of the tables' error (a vector's quantisation error seen from a random side) within which others are reranked too.
CELL, BLOCK, RERANK, SURE = 4096, 2048, 4, 2.5
#: Share of the true neighbours that the probed lists of sample queries must hold; queries audited against all rows, and the recall that is enough.
COVER, AUDIT, LEAST_RECALL = 0.97, 64, 0.94


def usable(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector that takes part (of ``dim`` components, all finite, not all zero), and these as doubles."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ok = size > 0 if dim is None else size == dim
    if not ok.any():
        return np.zeros(len(size), bool), np.zeros((0, dim or 0))
    dim = dim or int(size[ok][0])
    ok &= size == dim
    flat = column.filter(pa.array(ok)).flatten()
    x = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    ok[np.flatnonzero(ok)[~good]] = False
    return ok, x[good]


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest(x, c)
        order = np.argsort(at, kind="stable")
        some, first = np.unique(at[order], return_index=True)
        c[some] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The place of the nearest of ``c`` to each of ``x``."""
    half = 0.5 * (c * c).sum(1)
    return np.concatenate([np.argmax(x[a : a + 4096] @ c.T - half, 1) for a in range(0, len(x), 4096)])


@dataclass
class Index:
    tops: np.ndarray
    edges: np.ndarray  # the lists under each of ``tops``
    centroids: np.ndarray
    books: np.ndarray  # subspaces x codes x components
    probes: int

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Each vector's list: the nearest under its nearest top."""
        top, out = nearest(x, self.tops), np.zeros(len(x), np.int64)
        for t in np.unique(top):
            own = top == t
            out[own] = self.edges[t] + nearest(x[own], self.centroids[self.edges[t] : self.edges[t + 1]])
        return out

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = self.assign(x)
        rest = (x - self.centroids[lists]).reshape(len(x), self.books.shape[0], -1)
        codes = [nearest(rest[:, m], b) for m, b in enumerate(self.books)]
        return lists, np.stack(codes, 1).astype(np.uint8)

    def probe(self, q: np.ndarray, probes: int) -> np.ndarray:
        near = q @ self.centroids.T
        if probes >= near.shape[1]:
            return np.tile(np.arange(near.shape[1]), (len(q), 1))
        return np.argpartition(-near, probes - 1, axis=1)[:, :probes]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Subspaces x codes x queries: the inner products with all residual codes. A code's row has all queries side by side."""
        m = self.books.shape[0]
        return np.matmul(self.books, q.reshape(len(q), m, -1).transpose(1, 2, 0)).astype(np.float32)


def fit(x: np.ndarray, lists: int | None = None, subspaces: int = SUBSPACES, k: int = 20, cover: float = COVER, total: int | None = None) -> Index:
    """From a sample. ``total``: rows of the table, which the number of lists follows."""
    n, dim = x.shape
    while dim % subspaces:
        subspaces -= 1
    lists = max(1, min(lists or -(-(total or n) // LIST), LISTS, n // 8))
    tops = kmeans(x, max(1, round(np.sqrt(lists))))
    at = nearest(x, tops)
    share = np.maximum(1, np.round(np.bincount(at, minlength=len(tops)) * (lists / n))).astype(int)
    parts = [kmeans(x[at == t], int(share[t]), seed=t) if (at == t).any() else tops[t : t + 1] for t in range(len(tops))]
    index = Index(tops, np.concatenate([[0], np.cumsum([len(c) for c in parts])]), np.concatenate(parts), np.zeros((0, 0, 0)), 1)
    at = index.assign(x)
    rest = (x - index.centroids[at]).reshape(n, subspaces, -1)[np.random.default_rng(2).permutation(n)[:SAMPLE]]
    index.books = np.stack([_padded(kmeans(rest[:, m], CODES, rounds=8, seed=m)) for m in range(subspaces)])
    q = x[np.random.default_rng(1).choice(n, min(400, n), replace=False)]
    top = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, : k + 1]
    order = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(index.centroids))[None, :], axis=1)
    needed = np.take_along_axis(rank, at[top], axis=1).ravel()
    index.probes = min(int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(cover * len(needed))))]) + 1, len(index.centroids))
    return index


def _padded(c: np.ndarray) -> np.ndarray:
    return c if len(c) == CODES else np.concatenate([c, np.full((CODES - len(c), c.shape[1]), 1e30)])


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)


CODED = "vec_id long, sha binary, list int, codes binary, vector binary"


def _code(held, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        index = pickle.loads(held.value)  # noqa: S301  of our own making
        for batch in batches:
            ok, x = usable(batch.column("embedding"), dim)
            ok &= pc.is_valid(batch.column("vec_id")).to_numpy(zero_copy_only=False)
            if not ok.any():
                continue
            _, x = usable(batch.column("embedding").filter(pa.array(ok)), dim)
            lists, codes = index.encode(x)
            raw = [v.tobytes() for v in x + 0.0]  # one zero
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(ok)), pa.array([xxhash.xxh3_128_digest(v) for v in raw], pa.binary()), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "sha", "list", "codes", "vector"])

    return run


def _deal(held, probes: int, cells_of: np.ndarray):
    """Queries to the cells of the lists they probe: (cell, sha, vector), once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pickle.loads(held.value)  # noqa: S301
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                some = batch.slice(a, 1024)
                probed = index.probe(_vectors(some.column("vector")), probes)
                row, lists = np.repeat(np.arange(len(probed)), probed.shape[1]), probed.ravel()
                first, n = cells_of[lists, 0], cells_of[lists, 1]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                pairs = np.unique(np.repeat(row, n) * (1 << 32) + np.repeat(first, n) + step)
                row, cell = pairs >> 32, pairs & ((1 << 32) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), some.column("sha").take(pa.array(row)), some.column("vector").take(pa.array(row))], names=["cell", "sha", "vector"])

    return run


FOUND = "sha binary, vec_id long, score double"


def _search(held, probes: int, k: int):
    """The ``k`` best of a cell for each of its queries."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"sha": pa.array([], pa.binary()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return none
        index = pickle.loads(held.value)  # noqa: S301
        ids, lists = right.column("vec_id").to_numpy(), right.column("list").to_numpy()
        whole = np.array(right.column("sha").to_pylist())
        order = np.lexsort((whole, ids))  # ties go to the smaller id
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[order][1:] != ids[order][:-1]) | (whole[order][1:] != whole[order][:-1])
        order = order[keep]
        ids, lists = ids[order], lists[order]
        codes = np.frombuffer(b"".join(right.column("codes").to_pylist()), np.uint8).reshape(right.num_rows, -1)[order]
        x = _vectors(right.column("vector"))[order]
        rest = x - index.centroids[lists] - np.concatenate([index.books[m][codes[:, m]] for m in range(codes.shape[1])], axis=1)
        slack = (SURE * np.sqrt((rest * rest).sum(1) / x.shape[1])).astype(np.float32)
        out: list[pa.Table] = []
        for at in range(0, left.num_rows, 256):
            some = left.slice(at, 256)
            q = _vectors(some.column("vector"))
            norm = np.sqrt((q * q).sum(1)).astype(np.float32)
            probed = np.zeros((len(q), len(index.centroids)), bool)
            np.put_along_axis(probed, index.probe(q, probes), True, axis=1)
            tables, near = index.tables(q), (index.centroids @ q.T).astype(np.float32)
            score = near[lists]  # vectors x queries
            for m in range(codes.shape[1]):
                score += tables[m][codes[:, m]]
            score = np.where(probed.T[lists], score, np.float32(-np.inf)).T
            i, j = _best(score, RERANK * k)
            if len(ids) > RERANK * k:
                # What the tables may have put too low: all that their error could carry to the k-th best of these.
                exact = np.full(score.shape, -np.inf)
                exact[i, j] = np.where(score[i, j] > -np.inf, (q[i] * x[j]).sum(1), -np.inf)
                floor = -np.partition(-exact, k - 1, axis=1)[:, k - 1]
                i, j = np.nonzero((score > -np.inf) & ((exact > -np.inf) | (score + slack * norm[:, None] >= floor[:, None])))
            else:
                i, j = (c[score[i, j] > -np.inf] for c in (i, j))
            exact = (q[i] * x[j]).sum(1)
            by = np.lexsort((j, -exact, i))
            rank = np.arange(len(by)) - np.searchsorted(i[by], i[by])
            by = by[rank < k]
            out.append(pa.table({"sha": some.column("sha").take(pa.array(i[by])), "vec_id": pa.array(ids[j[by]]), "score": pa.array(exact[by])}))
        return pa.concat_tables([none, *out])

    return run


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` largest of each row."""
    if score.shape[1] <= k:
        return tuple(x.ravel() for x in np.indices(score.shape))  # type: ignore[return-value]
    j = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(score)), k), j.ravel()


def _brute(held, k: int):
    """The ``k`` best rows of a partition for each audited query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shas, q = pickle.loads(held.value)  # noqa: S301
        best = np.full((len(q), 0), 0.0)
        for batch in batches:
            if batch.num_rows:
                best = np.concatenate([best, q @ _vectors(batch.column("vector")).T], axis=1)
                best = -np.sort(-best, axis=1)[:, :k]
        row = np.repeat(np.arange(len(q)), best.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(shas, pa.binary()).take(pa.array(row)), pa.array(best.ravel())], names=["sha", "score"])

    return run


def _top(df: DataFrame, by: str, k: int, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def search(vectors: DataFrame, every: int = 20, k: int = 20, sample: int = SAMPLE, lists: int | None = None) -> DataFrame:
    """The ``k`` nearest found of each query, the rows of ``vectors (vec_id long, embedding array, ...)`` whose id is
    divisible by ``every``, among all other rows: query_id, rank (from 1), vec_id, score, the inner product in double precision, and
    audit_recall, the share of their true neighbours that audited queries found. Ties go to the smaller vec_id.

    Rows with a null id, or whose vector is null, zero, of another length than most, or holds a null or non-finite
    component, take no part. Rows that repeat an id and its vector are one. An id with several vectors is several candidates, and as a query
    has the one whose digest is smallest. An empty table gives no rows. Further columns are ignored.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    sizes = vectors.where("embedding IS NOT NULL AND vec_id IS NOT NULL AND size(embedding) > 0").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim, total = (sizes[0], sizes[1]) if sizes else (0, 0)
    wanted = max(sample, PER_LIST * min(LISTS, -(-total // LIST)))
    some = vectors.where((F.size("embedding") == dim) & F.col("vec_id").isNotNull()).orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).toArrow()
    x = usable(some.column("embedding").combine_chunks(), dim)[1] if total else np.zeros((0, 0))
    if not len(x):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, audit_recall double")
    index = fit(x, lists, k=k, total=total)
    held = spark.sparkContext.broadcast(pickle.dumps(index))
    coded = cut(vectors.mapInArrow(_code(held, dim), CODED))
    # Of copies of a vector no more ids than a result could name, and one that may be the query's own.
    rows = cut(coded.withColumn("place", F.dense_rank().over(Window.partitionBy("sha").orderBy("vec_id"))).where(F.col("place") <= k + 1).drop("place"))
    cells_of = _cells(rows, len(index.centroids))
    cells = spark.createDataFrame([(a, *map(int, c)) for a, c in enumerate(cells_of)], "list int, first int, parts long")  # LISTS rows at most
    rows = rows.join(F.broadcast(cells), "list").withColumn("cell", (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts"))).cast("int")).drop("first", "parts")
    asked = cut(coded.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("sha").alias("sha")))
    queries = cut(coded.where(F.col("vec_id") % every == 0).join(asked.select(F.col("query_id").alias("vec_id"), "sha"), ["vec_id", "sha"], "left_semi").groupBy("sha").agg(F.first("vector").alias("vector")))

    def found(queries: DataFrame, probes: int) -> DataFrame:
        """(sha, vec_id, score): the k + 1 best for each query."""
        dealt = cut(queries.mapInArrow(_deal(held, probes, cells_of), "cell int, sha binary, vector binary"))
        # A cell that very many queries probe is copied, once for each block of them.
        crowded = cut(dealt.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
        left = dealt.join(F.broadcast(crowded), "cell").withColumn("block", F.pmod(F.xxhash64("sha"), F.col("blocks").cast("long")).cast("int"))
        right = rows.join(F.broadcast(crowded), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        both = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(_search(held, probes, k + 1), FOUND)
        return cut(_top(both, "sha", k + 1, F.desc("score"), "vec_id").drop("rank"))

    audited = queries.orderBy(F.xxhash64("sha")).limit(AUDIT).collect()
    test = spark.sparkContext.broadcast(pickle.dumps(([bytes(r["sha"]) for r in audited], np.array([np.frombuffer(r["vector"]) for r in audited]).reshape(len(audited), dim))))
    true = cut(_top(rows.mapInArrow(_brute(test, k + 1), "sha binary, score double"), "sha", k + 1, F.desc("score")).groupBy("sha").agg(F.min("score").alias("least"), F.count("*").alias("n"))) if audited else None
    probes, recall = index.probes, 1.0
    while True:
        best = found(queries, probes)
        if true is not None:  # found as near as the farthest of the true neighbours, but for rounding
            near = best.join(F.broadcast(true), "sha").where(F.col("score") >= F.col("least") - 1e-9 * F.greatest(F.lit(1.0), F.abs("least"))).count()
            recall = near / true.agg(F.sum("n")).first()[0]
        if recall >= LEAST_RECALL or probes >= len(index.centroids):
            break
        probes *= 2
    most = min(k + 1, rows.select("vec_id").distinct().limit(k + 1).count())
    short = cut(queries.join(best.groupBy("sha").agg(F.count_distinct("vec_id").alias("n")).where(F.col("n") >= most), "sha", "left_anti"))
    if not short.isEmpty():
        best = best.join(short, "sha", "left_anti").unionByName(found(short, len(index.centroids)))
    out = asked.join(best, "sha").where("query_id <> vec_id")
    out = _top(out, "query_id", k, F.desc("score"), "vec_id")
    return out.select("query_id", "rank", "vec_id", "score", F.lit(recall).alias("audit_recall"))


def _cells(rows: DataFrame, lists: int) -> np.ndarray:
    """Lists, by size (a row each), to cells of neighbouring lists: the first cell, and the cells, of each list."""
    size = np.zeros(lists, np.int64)
    for a, n in rows.groupBy("list").count().collect():
        size[a] = n
    out, cell, room = np.zeros((lists, 2), np.int64), -1, 0
    for a, n in enumerate(size.tolist()):
        if n > CELL:
            parts = -(-n // CELL)
            out[a], cell, room = (cell + 1, parts), cell + parts, 0
        else:
            if n > room:
                cell, room = cell + 1, CELL
            out[a], room = (max(cell, 0), 1), room - n
    return out
