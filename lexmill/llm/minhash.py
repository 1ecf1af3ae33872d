"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of word shingles. Their MinHash signatures are banded into
buckets; candidate pairs of a bucket have their signatures compared batch by batch,
and a pair is dropped as soon as the posterior probability that its similarity
reaches the threshold falls under a chosen miss probability. What survives is
verified on the full sets, exactly.

No group of copies is expanded into its pairs. Documents with equal sets are one class
with one representative. In a bucket every representative is first compared with a leader
of its part, and the leaders with the bucket's own; only representatives of one bucket that
these links leave in different components are compared with each other, in blocks of a
bounded size, so that every link that joins different components is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import coded, components, cut, mix64, rolling, slices, small, starts_within, word_hashes, words_of

#: Rows of a signature and rows to a band. At similarity 0.8 a pair shares no band with probability 3e-6.
N_HASHES, BAND_ROWS = 160, 5
#: Signature rows compared before each look at the posterior.
BATCH = 32
#: A pair goes when the posterior probability of reaching the threshold is under this.
MISS = 1e-7
#: Members up to which a bucket has one leader; members, and shingles of their sets, on each side of a block of the second comparison, about.
PARTS, BLOCK, BLOCK_SHINGLES = 64, 256, 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def posterior_floor(n: int, threshold: float, miss: float) -> int:
    """The least number of equal rows out of ``n`` with which a pair stays: with a uniform
    prior, P(similarity >= t | k of n) = P(Binomial(n + 1, t) <= k)."""
    total = 0.0
    for k in range(n + 1):
        total += comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k)
        if total >= miss:
            return k
    return n


def floors(threshold: float, miss: float, n: int = N_HASHES, batch: int = BATCH) -> list[tuple[int, int]]:
    return [(m, posterior_floor(m, threshold, miss)) for m in range(batch, n + 1, batch)]


def sequential(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Places of the pairs (row of ``a``, row of ``b``) that no look at the posterior drops."""
    left, at = np.arange(len(a)), 0
    equal = np.zeros(len(a), np.int32)
    for n, least in bounds:
        equal = equal + (a[left, at:n] == b[left, at:n]).sum(1, dtype=np.int32)
        keep = equal >= least
        left, equal, at = left[keep], equal[keep], n
    return left


def _coefficients(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, flat, and the texts' offsets.

    A-Z are lower-cased, words are ``[^\\x20\\x09-\\x0D]+``. A text of fewer than ``k``
    words has its whole sequence as one shingle; one without words has none.
    """
    texts = texts.cast(pa.large_string())
    if pc.any(pc.match_substring_regex(texts, "[A-Z]")).as_py():
        s = pc.fill_null(texts, "")
        ends = np.frombuffer(s.buffers()[1], np.int64)[s.offset : s.offset + len(s) + 1]
        raw = np.frombuffer(s.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].copy()  # a slice shares the letters of its whole batch
        raw[(raw >= 65) & (raw <= 90)] += 32
        texts = pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(ends - ends[0]), pa.py_buffer(raw))
    words, off = words_of(texts)
    idx, vocab = coded(words)
    h = word_hashes(vocab)[idx]
    good = starts_within(off, k)
    at = np.flatnonzero(good)
    owner = np.searchsorted(off, at, side="right") - 1
    x = rolling(h, k)[at]
    short = np.flatnonzero((np.diff(off) > 0) & (np.diff(off) < k))
    if len(short):
        extra = np.array([np.uint64(mix64(rolling(h[off[i] : off[i + 1]], int(off[i + 1] - off[i])) + np.uint64(off[i + 1] - off[i]))[0]) for i in short], np.uint64)
        x, owner = np.concatenate([x, extra]), np.concatenate([owner, short])
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    x, owner = x[new], owner[new]
    return x, np.searchsorted(owner, np.arange(len(off)))


def signatures_of(x: np.ndarray, off: np.ndarray, n: int = N_HASHES) -> np.ndarray:
    """A row of the low 16 bits of ``n`` minima per text (all ones where the set is empty). Equal minima
    have equal bits; others do by chance once in 65536 rows, which never makes a pair look less similar."""
    a, b = _coefficients(n)
    out = np.full((len(off) - 1, n), 2**16 - 1, np.uint16)
    full = np.flatnonzero(np.diff(off) > 0)
    y = (mix64(x) >> np.uint64(32)).astype(np.uint32)
    i = 0
    while i < len(full):  # blocks of texts whose hashes stay in the processor's cache
        j = max(i + 1, int(np.searchsorted(off[full], off[full[i]] + 8192)))
        some = full[i:j]
        part = y[off[some[0]] : off[some[-1] + 1]]
        at = off[some] - off[some[0]]
        for r in range(n):
            out[some, r] = np.minimum.reduceat(part * a[r] + b[r], at).astype(np.uint16)
        i = j
    return out


SIGNED = "doc_id long, n_shingles long, set_id binary, signature binary"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            x, off = shingle_sets(batch.column("text"), k)
            sig = signatures_of(x, off)
            size = np.diff(off)
            sets = [xxhash.xxh3_128_digest(x[off[i] : off[i + 1]].tobytes()) if size[i] else None for i in range(len(size))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(sets, pa.binary()), pa.array([s.tobytes() if n else None for s, n in zip(sig, size, strict=True)], pa.binary())], names=["doc_id", "n_shingles", "set_id", "signature"])

    return run


def _signature_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, N_HASHES)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _signature_matrix(batch.column("signature"))
        ids = batch.column("rep").to_numpy()
        for band in range(N_HASHES // BAND_ROWS):
            h = np.full(len(sig), np.uint64(band + 1))
            for r in range(BAND_ROWS):
                h = mix64(h * np.uint64(6364136223846793005) + sig[:, band * BAND_ROWS + r])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids)], names=["bucket", "rep"])


def _compare(bounds: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = sequential(_signature_matrix(batch.column("sig_u")), _signature_matrix(batch.column("sig_v")), bounds)
                yield batch.select(["u", "v"]).take(pa.array(keep))

    return run


def _alike(p: bytes, q: bytes, percent: int) -> bool:
    a, b = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compare_block(bounds: list[tuple[int, int]], percent: int):
    """Links between the vectors of side 0 and side 1 of a block, as many as join its components: of
    pairs in different components those that survive the posterior are verified on their sets, and
    a link found joins its components for the rest of the block."""

    def run(table: pa.Table) -> pa.Table:
        sig = _signature_matrix(table.column("signature").combine_chunks())
        sets = table.column("shingles").to_pylist()
        ids, comp, side = (table.column(c).to_numpy() for c in ("rep", "component", "side"))
        comp = comp.copy()
        us, vs = [], []
        cols = np.flatnonzero(side == 1)
        for i in np.flatnonzero(side == 0):
            other = cols[comp[cols] != comp[i]]
            if len(other):
                for j in other[sequential(np.broadcast_to(sig[i], (len(other), N_HASHES)), sig[other], bounds)]:
                    if comp[j] != comp[i] and _alike(sets[i], sets[j], percent):
                        us.append(ids[i])
                        vs.append(ids[j])
                        comp[comp == comp[j]] = comp[i]
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, off = shingle_sets(batch.column("text"), k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[off[i] : off[i + 1]].tobytes() for i in range(batch.num_rows)], pa.binary())], names=["id", "shingles"])

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_alike(p, q, percent) for p, q in zip(batch.column("set_u").to_pylist(), batch.column("set_v").to_pylist(), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row per row of ``docs (doc_id long, text string, ...)``: doc_id, n_shingles,
    component_id (smallest doc_id reachable by links, itself included) and kept.

    Two documents are linked when 100 * |intersection| >= percent * |union| of their sets of
    ``shingle``-word shingles (64-bit hashes).

    Null or empty text, or text without words: n_shingles 0, linked with nothing. Null doc_id:
    linked with nothing, component_id null, kept. Rows that repeat a doc_id with the same text
    are one document, each with the same result; with other texts under one doc_id, the rows of
    the id are one node of the graph, with the links of each. An empty table
    gives no rows. Further columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(docs.mapInArrow(_sign(shingle), SIGNED))
    n = signed.count()
    usable = signed.where("doc_id IS NOT NULL AND set_id IS NOT NULL")
    classes = cut(usable.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"), F.first("n_shingles").alias("weight")), n)  # equal sets have equal signatures
    reps, weights, classes = classes.select("rep", "signature"), classes.select("rep", "weight"), classes.select("set_id", "rep")
    bounds = floors(percent / 100, miss)

    bands = reps.mapInArrow(_bands, "bucket long, rep long")
    # Cut, so that both sides of the join are plain exchanges and a large bucket can be split.
    buckets = cut(bands.groupBy("bucket").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1"), n * N_HASHES // BAND_ROWS)
    members = cut(bands.join(buckets, "bucket"), n * N_HASHES // BAND_ROWS)
    m = members.count()
    part = F.pmod(F.xxhash64("rep", "bucket"), F.ceil(F.sqrt("n")).cast("long"))  # as many heads as members to each
    heads = members.groupBy("bucket", part.alias("part")).agg(F.min("rep").alias("head"), F.first("leader").alias("leader"))
    few = members.where(F.col("n") <= PARTS).select(F.col("leader").alias("u"), F.col("rep").alias("v"))
    large = members.where(F.col("n") > PARTS).withColumn("part", part).join(heads, ["bucket", "part"]).select(F.col("head").alias("u"), F.col("rep").alias("v"))
    top = heads.select(F.col("leader").alias("u"), F.col("head").alias("v"))
    pairs = few.unionByName(large).unionByName(top).where("u <> v").distinct()
    sig = reps.select(F.col("rep").alias("u"), F.col("signature").alias("sig_u"))
    survivors = cut(pairs.join(sig, "u").join(sig.select(F.col("u").alias("v"), F.col("sig_u").alias("sig_v")), "v").select("u", "v", "sig_u", "sig_v").mapInArrow(_compare(bounds), "u long, v long"), m)
    p = survivors.count()
    # The full sets, of representatives in a pair or in a bucket of more than two.
    ids = survivors.select("u").unionByName(survivors.select(F.col("v").alias("u"))).unionByName(members.where("n > 2").select(F.col("rep").alias("u"))).distinct()
    sets = cut(docs.join(small(cut(ids, m + 2 * p)), F.col("doc_id") == F.col("u"), "left_semi").mapInArrow(_sets(shingle), "id long, shingles binary"))
    both = survivors.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("set_u")), "u").join(sets.select(F.col("id").alias("v"), F.col("shingles").alias("set_v")), "v")
    links = cut(both.mapInArrow(_exact(percent), "u long, v long").distinct(), p)
    comps = cut(components(links, p), 2 * p)

    # Buckets whose members are still in different components: those outside the bucket's main
    # component (side 0) with all (side 1), in blocks.
    known = cut(members.where("n > 2").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("component")), m)
    split = known.groupBy("bucket", "component").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.max(F.struct("c", "component"))["component"].alias("main"), F.count("*").alias("comps")).where("comps > 1").select("bucket", "main")
    rest = cut(known.join(cut(split, m), "bucket").select("main", "rep", "component").distinct(), m)  # buckets of one main component together: each pair once
    blocks = lambda some: F.ceil(F.greatest(F.count(F.when(some, 1)) / BLOCK, F.coalesce(F.sum(F.when(some, F.col("weight"))), F.lit(0)) / BLOCK_SHINGLES)).cast("long")
    sizes = rest.join(weights, "rep").groupBy("main").agg(blocks(F.col("component") != F.col("main")).alias("i_blocks"), blocks(F.lit(True)).alias("j_blocks"))
    rest = rest.join(cut(sizes, m), "main")
    to = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    own = lambda blocks: F.pmod(F.xxhash64("rep"), F.col(blocks))
    left = rest.where("component <> main").select("main", "rep", "component", own("i_blocks").alias("i"), to("j_blocks").alias("j"), F.lit(0).alias("side"))
    right = rest.select("main", "rep", "component", to("i_blocks").alias("i"), own("j_blocks").alias("j"), F.lit(1).alias("side"))
    full = reps.join(sets.withColumnRenamed("id", "rep"), "rep")
    new = left.unionByName(right).join(full, "rep").groupBy("main", "i", "j").applyInArrow(_compare_block(bounds, percent), "u long, v long")
    new = cut(new.distinct(), m)
    if not new.isEmpty():
        comps = components(links.unionByName(new), p + m)
    named = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))
