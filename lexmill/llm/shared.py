"""What several operators of this subpackage use: lineage cuts, words, hashes, components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short rows that one file of a cut may hold.
FILE_ROWS = 100_000
#: Characters of text that a Python task works on at a time; bytes read between two releases of free memory.
SLICE_CHARS, RELEASE = 2_000_000, 32_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the cluster's ``spark.checkpoint.dir``;
    only where that is unset, as in local tests, a temporary one is set."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lexmill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def delete(spark: SparkSession, path: str) -> None:
    """A folder, on any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that a lost executor costs no more
    than the stage it was in. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark deletes
    the files once nothing refers to them. ``rows``: it has no more rows than that, and is written in so few files."""
    shared_folder(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Marked to be broadcast if its rows, counted, are no more than ``rows``; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def release() -> None:
    """Give back to the system what Arrow and the C library hold free: a worker process outlives its tasks, beside a full JVM heap."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each hold about ``chars`` bytes (a longer text stands alone). What they took is given back now and then."""
    done = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        if done > RELEASE:
            release()
            done = 0
        done += batch.nbytes
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // chars
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)
    release()


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of all texts in one flat array, and each text's
    offsets in it. A null text has no words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    ends = lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(full)]).astype(np.int64)
    return flat.filter(pa.array(full)), kept[ends]


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word's place in the array of distinct words, and that array."""
    if len(words) == 0:
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    d = words.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash for each word, of the word alone."""
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def rolling(h: np.ndarray, k: int, mult: int = 6364136223846793005) -> np.ndarray:
    """A hash of each ``k`` consecutive entries of ``h``: a polynomial in ``mult``, put together
    from hashes of 1, 2, 4, ... entries."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    part, width, out, done = h.astype(np.uint64), 1, None, 0
    while True:
        if k & width:
            m = len(part) if out is None else min(len(part), len(out) - width)
            out = part if out is None else part[:m] * np.uint64(pow(mult, done, 2**64)) + out[width : width + m]
            done += width
        if done == k:
            return mix64(out[:n])
        part = part[: len(part) - width] * np.uint64(pow(mult, width, 2**64)) + part[width:]
        width *= 2


def starts_within(offsets: np.ndarray, k: int) -> np.ndarray:
    """For the flat words of several texts: True where ``k`` words from there on are one text's."""
    n = int(offsets[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    size = np.diff(offsets)
    end = np.repeat(offsets[1:], size)[:n]
    return np.arange(n) + k <= end


def components(edges: DataFrame, rows: int | None = None, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (u long, v long)``, no more than ``rows``: rows ``(node, component)`` for
    every node of an edge, the component named by its smallest node.

    Alternates the large-star and small-star steps on the edge list. Each round takes a
    map-side minimum before it shuffles, and cuts it, so that the join with the edges of a node
    with many neighbours can be split. Rounds needed grow with the logarithm of the longest path.
    """
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows)
    before, rows = None, e.count()
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * rows)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = cut(small, 2 * rows)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, rows = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    low = e.groupBy("u").agg(F.min("v").alias("component"))
    return low.select(F.col("u").alias("node"), "component").unionByName(e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component")))
