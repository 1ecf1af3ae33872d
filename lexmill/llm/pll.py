"""Language-model scores by masked pseudo-likelihood.

A small network predicts each word from the ``SIDE`` words on both sides of it: an embedding for each
place of the window, summed, a tanh layer, and a factored softmax, over groups of symbols and over the symbols of a group. It is
written and trained in numpy. A document's score is the sum of the log-probabilities of all its words, each masked in turn:
log p(group | both sides) + log p(symbol | group, both sides) + log p(word | symbol).

The network predicts a fixed number of symbols, by falling frequency in groups: the most frequent words of the whole corpus (as buckets of a hash), and for
the other words a class by their last letters. The vocabulary is every word of the corpus: p(word | symbol) is the word's
count in all documents to its symbol's. Those counts lie in shards, by the words' hashes, that grow in number with the corpus;
blocks of documents ask the shards for the counts of their distinct words, so that no process holds the vocabulary.

Texts are read once, into blocks of numbered words (``encode``), which the counts, the training and the scores are made from. Training covers all documents: in each of ``ROUNDS``
rounds every task masks every ``EVERY``-th word of its documents, with another offset each round so that each word is once a target, and trains its own copy
of the network; Spark averages the copies, weighted by the words trained on, in fixed-point numbers so that
reruns agree. The network is of a fixed size; the word counts grow with the corpus.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import coded, cut, slices, word_hashes, words_of

#: Symbols (0 stands outside a document, then known words, then classes of other words), the classes among them, and groups.
SYMBOLS, CLASSES, GROUPS = 1024, 256, 32
WIDTH = SYMBOLS // GROUPS
#: Hidden units; words on each side; buckets that words are counted in.
HIDDEN, SIDE, BUCKETS = 16, 3, 2**16
#: Rounds of training, and one word in how many each round masks: every word once over the rounds.
ROUNDS, EVERY = 2, 2
#: Words of a training step at most, and steps that a smaller block is cut into.
BATCH, STEPS_OF_BLOCK, RATE = 4096, 64, 0.01
#: Steps to one in a fixed-point parameter; words to one unit of weight.
STEPS, UNIT = 2**24, 10_000
#: Bytes of text to a shard of the word counts, and to a block of documents; distinct words a task holds.
SHARD_BYTES, BLOCK_BYTES, HELD = 2**25, 2**23, 1_000_000
COUNTS = "hashes binary, counts binary"
BLOCKS = "home long, size long, blob binary"


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int64)


def classes_of(words: pa.Array) -> np.ndarray:
    """A class by the last two bytes."""
    words = words.cast(pa.large_binary())
    if not len(words):
        return np.zeros(0, np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8).astype(np.int64)
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    return (raw[ends[1:] - 1] * 31 + np.where(np.diff(ends) > 1, raw[ends[1:] - 2], 0)) % CLASSES


@dataclass
class Block:
    """Documents in numbered words: ids (null where ``null``), offsets, each word's number, and the hash and class of each number."""

    doc_id: np.ndarray
    null: np.ndarray
    off: np.ndarray
    idx: np.ndarray
    hashes: np.ndarray
    classes: np.ndarray

    @classmethod
    def of(cls, doc_id: pa.Array, texts: pa.Array) -> Block:
        words, off = words_of(texts)
        idx, vocab = coded(words)
        null = doc_id.is_null().to_numpy(zero_copy_only=False)
        return cls(doc_id.fill_null(0).to_numpy(zero_copy_only=False), null, off, idx.astype(np.int32), word_hashes(vocab, seed=5), classes_of(vocab).astype(np.int16))

    def packed(self) -> bytes:
        import zstandard

        return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(self, 5))

    @classmethod
    def unpacked(cls, blob: bytes) -> Block:
        import zstandard

        return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))  # noqa: S301  of our own making

    def counts(self) -> np.ndarray:
        return np.bincount(self.idx, minlength=len(self.hashes)).astype(np.int64)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        block = Block.of(table.column("doc_id").combine_chunks(), table.column("text").cast(pa.large_string()).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([home], pa.int64()), pa.array([size], pa.int64()), pa.array([block.packed()], pa.binary())], names=["home", "size", "blob"])

    home, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in slices(batches, chars=BLOCK_BYTES // 4):
        held.append(batch)
        size += batch.column("text").nbytes
        if size >= BLOCK_BYTES:
            yield flush()
            home, held, size = home + 1, [], 0
    if held:
        yield flush()


def encode(docs: DataFrame) -> DataFrame:
    """``docs (doc_id, text, ...)`` in blocks of numbered words (home, size, blob), written to the shared folder."""
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode, BLOCKS))


def _blocks(docs: DataFrame) -> DataFrame:
    return docs if docs.columns == ["home", "size", "blob"] else encode(docs)


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of each column: numpy finds maxima and sums over a short first axis several times faster than over a short last one."""
    x -= x.max(0)
    np.exp(x, out=x)
    x /= x.sum(0)
    return x


def _own(x: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The log-softmax of each column's row."""
    x -= x.max(0)
    own = x[row, np.arange(x.shape[1])]
    return own - np.log(np.exp(x, out=x).sum(0))


@dataclass
class Network:
    known: np.ndarray  # bucket -> symbol, or 0
    place: np.ndarray  # places x symbols x hidden
    bias: np.ndarray
    top: np.ndarray  # hidden x groups
    top_bias: np.ndarray
    out: np.ndarray  # groups x hidden x symbols of a group
    out_bias: np.ndarray
    totals: np.ndarray | None = None  # symbol -> words of the corpus
    words: DataFrame | None = None  # (shard, hashes, counts): each word's count in the corpus
    shards: int = 1

    def __getstate__(self) -> dict:
        return {**self.__dict__, "words": None}

    @classmethod
    def new(cls, known: np.ndarray, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        zero = lambda *shape: np.zeros(shape, np.float32)
        return cls(known, draw(2 * SIDE, SYMBOLS, HIDDEN), zero(HIDDEN), draw(HIDDEN, GROUPS), zero(GROUPS), draw(GROUPS, HIDDEN, WIDTH), zero(GROUPS, WIDTH), np.zeros(SYMBOLS, np.int64))

    def parameters(self) -> list[np.ndarray]:
        return [self.place, self.bias, self.top, self.top_bias, self.out, self.out_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parameters():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def symbols(self, b: Block) -> np.ndarray:
        """Of each numbered word."""
        s = self.known[buckets_of(b.hashes)]
        return np.where(s > 0, s, SYMBOLS - CLASSES + b.classes).astype(np.int32)

    @staticmethod
    def windows(symbols: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words' symbols with ``SIDE`` outside symbols around each document, and the place of each word there."""
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        at = np.arange(len(symbols)) + (doc + 1) * SIDE
        line = np.zeros(len(symbols) + len(off) * SIDE, np.int32)
        line[at] = symbols
        return line, at

    def hidden(self, line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        around = [line[at + d] for d in (*range(-SIDE, 0), *range(1, SIDE + 1))]
        z = self.place[0].take(around[0], axis=0)
        z += self.bias
        for k in range(1, 2 * SIDE):
            z += self.place[k].take(around[k], axis=0)
        return np.tanh(z, out=z), around

    @staticmethod
    def grouped(symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """The order that brings the symbols of a group together, and (group, from, to) in it."""
        group = symbols // WIDTH
        order = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[order], np.arange(GROUPS + 1)).tolist()
        return order, [(g, a, b) for g, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]

    def log_probabilities(self, line: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        for a in range(0, len(at), BATCH):  # parts that stay in the processor's cache
            some = at[a : a + BATCH]
            order, groups = self.grouped(line[some])
            some = some[order]
            h, _ = self.hidden(line, some)
            target = line[some]
            h, group, within = h.T, target // WIDTH, target % WIDTH
            own = _own(self.top.T @ h + self.top_bias[:, None], group)
            for g, x, y in groups:
                own[x:y] += _own(self.out[g].T @ h[:, x:y] + self.out_bias[g][:, None], within[x:y])
            out[a + order] = own
        return out

    def train(self, line: np.ndarray, at: np.ndarray, state: list[tuple[np.ndarray, np.ndarray]], t: int) -> int:
        """Adam steps over the masked places; returns the steps done so far."""
        batch = min(BATCH, max(64, len(at) // STEPS_OF_BLOCK))
        for a in range(0, len(at), batch):
            some = at[a : a + batch]
            order, groups = self.grouped(line[some])
            some = some[order]
            h, around = self.hidden(line, some)
            target, n, h = line[some], len(some), h.T
            p = _softmax(self.top.T @ h + self.top_bias[:, None])
            p[target // WIDTH, np.arange(n)] -= 1
            p /= n
            within = target % WIDTH
            dh, out, out_bias = self.top @ p, np.zeros_like(self.out), np.zeros_like(self.out_bias)
            for g, x, y in groups:
                q = _softmax(self.out[g].T @ h[:, x:y] + self.out_bias[g][:, None])
                q[within[x:y], np.arange(y - x)] -= 1
                q /= n
                dh[:, x:y] += self.out[g] @ q
                out[g], out_bias[g] = h[:, x:y] @ q.T, q.sum(1)
            dz = dh * (1 - h * h)
            place, weights = np.empty_like(self.place), dz.astype(np.float64)
            for k, x in enumerate(around):
                x = x.astype(np.intp)
                for unit in range(HIDDEN):
                    place[k, :, unit] = np.bincount(x, weights=weights[unit], minlength=SYMBOLS)
            t += 1
            for value, g, (m, v) in zip(self.parameters(), (place, dz.sum(1), h @ p.T, p.sum(1), out, out_bias), state, strict=True):
                m += np.float32(0.1) * (g - m)
                v += np.float32(0.01) * (g * g - v)
                value -= np.float32(RATE / (1 - 0.9**t)) * m / (np.sqrt(v * np.float32(1 / (1 - 0.99**t))) + np.float32(1e-8))
        return t


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and the sums of their counts."""
    h, n = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first], np.add.reduceat(n, first)


def _sharded(h: np.ndarray, n: np.ndarray, shards: int, home: int) -> pa.RecordBatch:
    """A row for each shard that has some of the words: (shard, home, hashes, counts)."""
    shard = buckets_of(h) % shards
    order = np.argsort(shard, kind="stable")
    shard, h, n = shard[order], h[order], n[order]
    edges = [*np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist(), len(h)]
    pieces = list(zip(edges[:-1], edges[1:], strict=True))
    rows = pa.array(shard[edges[:-1]]), pa.array(np.full(len(pieces), home, np.int64)), *(pa.array([x[a:b].tobytes() for a, b in pieces], pa.binary()) for x in (h, n))
    return pa.RecordBatch.from_arrays(list(rows), names=["shard", "home", "hashes", "counts"])


def _unpacked(table: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = (b"".join(table.column(c).to_pylist()) for c in ("hashes", "counts"))
    return np.frombuffer(hashes, np.uint64), np.frombuffer(counts, np.int64)


def _count(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                b = Block.unpacked(blob)
                if not len(b.hashes):
                    continue
                held.append((b.hashes, b.counts()))
                waiting += len(b.hashes)
                if waiting > HELD:
                    held = [_summed(*map(list, zip(*held, strict=True)))]
                    waiting = 0
                    if len(held[0][0]) > HELD:
                        yield _sharded(*held.pop(), shards, 0)
        if held:
            yield _sharded(*_summed(*map(list, zip(*held, strict=True))), shards, 0)

    return run


def _sum_shard(table: pa.Table) -> pa.Table:
    h, n = _unpacked(table)
    h, n = _summed([h], [n])
    return pa.table({"shard": table.column("shard").slice(0, 1), "hashes": pa.array([h.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary())})


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            h, n = _unpacked(batch)
            total = np.zeros(BUCKETS, np.int64)
            np.add.at(total, buckets_of(h), n)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])


def _train(held, turn: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = pickle.loads(held.value)  # noqa: S301  of our own making
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
        trained, t, totals = 0, 0, np.zeros(SYMBOLS, np.int64)
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                b = Block.unpacked(blob)
                own = net.symbols(b)
                if turn == 0:
                    totals += np.bincount(own, weights=b.counts(), minlength=SYMBOLS).astype(np.int64)
                line, at = net.windows(own[b.idx], b.off)
                size = np.diff(b.off)
                place = np.arange(len(b.idx)) - np.repeat(b.off[:-1], size)
                some = at[(place + np.repeat(size, size)) % every == turn * every // ROUNDS]
                t = net.train(line, np.random.default_rng(len(some)).permutation(some), state, t)
                trained += len(some)
        if trained:
            weight = -(-trained // UNIT)
            flat = np.round(net.flat().astype(np.float64) * STEPS).astype(np.int64) * weight
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array(np.full(len(flat), weight))], names=["place", "value", "weight"])
        some = np.flatnonzero(totals)
        if len(some):  # behind the parameters: the words of each symbol
            yield pa.RecordBatch.from_arrays([pa.array((some + len(net.flat())).astype(np.int32)), pa.array(totals[some]), pa.array(np.zeros(len(some), np.int64))], names=["place", "value", "weight"])

    return run


def fit(docs: DataFrame, every: int = EVERY) -> Network:
    """A network of a fixed size, and the counts of all words, from all of ``docs (doc_id, text, ...)`` or what ``encode`` made of them."""
    spark, blocks = docs.sparkSession, _blocks(docs)
    size = blocks.agg(F.sum("size")).first()[0] or 0
    shards = min(BUCKETS, 1 + size // SHARD_BYTES)
    vocabulary = cut(blocks.mapInArrow(_count(shards), f"shard long, home long, {COUNTS}").groupBy("shard").applyInArrow(_sum_shard, f"shard long, {COUNTS}"))
    counts = vocabulary.mapInArrow(_bucket_counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "bucket").limit(SYMBOLS - CLASSES - 1).collect()
    known = np.zeros(BUCKETS, np.int32)
    for k, (bucket, _) in enumerate(top):
        known[bucket] = k + 1
    net = Network.new(known)
    net.words, net.shards = vocabulary, shards
    for turn in range(ROUNDS):
        held = spark.sparkContext.broadcast(pickle.dumps(net))
        summed = blocks.mapInArrow(_train(held, turn, every), "place int, value long, weight long").groupBy("place").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight")).toArrow()
        held.destroy()
        if summed.num_rows:
            place, value, weight = (summed.column(c).to_numpy() for c in ("place", "value", "weight"))
            flat = net.flat().astype(np.float64)
            own = place < len(flat)
            flat[place[own]] = value[own] / weight[own] / STEPS
            net.load(flat.astype(np.float32))
            net.totals[place[~own] - len(flat)] = value[~own]
    return net


def _ask(shards: int):
    """The distinct words of each block, to their shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for home, blob in zip(batch.column("home").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                h = Block.unpacked(blob).hashes
                if len(h):
                    yield _sharded(np.sort(h), np.zeros(len(h), np.int64), shards, home)

    return run


def _answer(asked: pa.Table, words: pa.Table) -> pa.Table:
    """The counts of what each block asked for; 0 for a word that the corpus doesn't hold."""
    h, n = _unpacked(words)
    counts = []
    for raw in asked.column("hashes").to_pylist():
        own = np.frombuffer(raw, np.uint64)
        at = np.minimum(np.searchsorted(h, own), max(len(h) - 1, 0))
        counts.append((np.where(h[at] == own, n[at], 0) if len(h) else np.zeros(len(own), np.int64)).tobytes())
    return pa.table({"home": asked.column("home"), "hashes": asked.column("hashes"), "counts": pa.array(counts, pa.binary())})


def score(docs: DataFrame, net: Network) -> DataFrame:
    """One row per row of ``docs (doc_id, text, ...)``, or of what ``encode`` made of them: doc_id, n_words, log_likelihood (the sum over all words of
    log p(word | both sides)) and mean_log_likelihood.

    A word that the network's corpus doesn't hold has the probability of one occurrence more in its symbol. Null and empty
    texts: no words, log_likelihood 0, mean 0. Repeated rows have equal scores; null ids are kept. An
    empty table gives no rows. Further columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(net))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        own: Network = pickle.loads(held.value)  # noqa: S301
        hashes, counts = _unpacked(right)
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        out = [pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "log_likelihood": pa.array([], pa.float64()), "mean_log_likelihood": pa.array([], pa.float64())})]
        for blob in left.column("blob").to_pylist():
            b = Block.unpacked(blob)
            symbols = own.symbols(b)
            line, at = own.windows(symbols[b.idx], b.off)
            within = np.log(np.maximum(counts[np.searchsorted(hashes, b.hashes)], 1) / (own.totals[symbols] + 1.0))
            upto = np.concatenate([[0.0], np.cumsum(own.log_probabilities(line, at) + within[b.idx])])
            total, n = upto[b.off[1:]] - upto[b.off[:-1]], np.diff(b.off)
            out.append(pa.table({"doc_id": pa.array(b.doc_id, pa.int64(), mask=b.null), "n_words": pa.array(n), "log_likelihood": pa.array(total), "mean_log_likelihood": pa.array(total / np.maximum(n, 1))}))
        return pa.concat_tables(out)

    blocks = _blocks(docs)
    asked = blocks.mapInArrow(_ask(net.shards), f"shard long, home long, {COUNTS}")
    answers = asked.groupBy("shard").cogroup(net.words.groupBy("shard")).applyInArrow(_answer, f"home long, {COUNTS}")
    return blocks.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(run, "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double")
