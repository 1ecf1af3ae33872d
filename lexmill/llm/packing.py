"""Best-fit packing of token pieces into sequences, certified by lower bounds.

Every partition packs its pieces by best-fit decreasing and certifies its number of bins with
lower bounds from dual-feasible functions. Where a partition has more bins than its bound, the
pieces of its bins that aren't full are exchanged: they are dealt anew, together, and packed
again by best-fit decreasing. Bins of partitions that meet their bound stay. The rounds go on, with as
many partitions as the exchanged pieces need, while they save bins; the last exchange is one
partition, so long as a partition can hold its pieces.
"""

from __future__ import annotations

import itertools
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import coded, cut, slices, words_of

#: Pieces that one task packs, at most about.
PART_PIECES = 100_000
#: Bytes, about, of distinct parts and their ids that a worker keeps from one slice of texts, and one task, to the next; bytes of one part besides its
#: letters; parts encoded as one text, and in one call; characters of a slice.
CACHE_BYTES, PART_BYTES, TOGETHER, AT_ONCE, CHARS = 80_000_000, 180, 1_000, 8_000, 2_000_000
ASCII_UPPER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0).astype(np.uint8)
LETTER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
PUNCTUATION = np.isin(np.arange(256), np.frombuffer(b".,!?*&%$#|;:", np.uint8))


class WordTokenizer:
    """Ids of whole texts from the ids of their words.

    For tokenizers that drop white space and whose pre-tokenizer joins nothing across it, nor a
    letter and the punctuation behind it, and that lower-case (as ``word_bpe_49k`` does): the ids of a text are then
    those of such parts in turn, and each distinct part is given to the tokenizer once. Many parts
    are encoded as one text, with a special token between them.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        # The same without its normalizer and its split, for parts that these leave as they are.
        self.plain = None
        kinds = json.loads(self.tokenizer.to_str())
        if [n.get("type") for n in (kinds["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [n.get("type") for n in (kinds["pre_tokenizer"] or {}).get("pretokenizers", [])] == ["Split", "ByteLevel"]:
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        special = [(t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark, self.mark_id = special[0] if special else ("", -1)
        self.clear()

    def clear(self) -> None:
        self.held: dict[str, int] = {}
        self.bytes = 0
        self.pool, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def parts_of(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words, with A-Z lower-cased and punctuation behind an ASCII letter parted from it. Texts in
        which a special token might stand are only cut at white space."""
        s = pc.fill_null(texts.cast(pa.large_string()), "")
        if pc.any(pc.match_substring(s, "<|")).as_py():
            return words_of(s)
        ends = np.frombuffer(s.buffers()[1], np.int64)[s.offset : s.offset + len(s) + 1]
        raw = np.frombuffer(s.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]  # a slice shares the letters of its whole batch
        ends = ends - ends[0]
        raw = raw | ASCII_UPPER[raw]
        at = np.flatnonzero(LETTER[raw[:-1]] & PUNCTUATION[raw[1:]]) + 1
        new = np.insert(raw, at, 32)
        return words_of(pa.LargeStringArray.from_buffers(len(s), pa.py_buffer(ends + np.searchsorted(at, ends)), pa.py_buffer(new)))

    def number(self, vocab: list[str]) -> np.ndarray:
        """Each part's place in ``first`` and ``size``, after encoding those that aren't held."""
        if self.bytes > CACHE_BYTES:
            self.clear()
        new = [w for w in vocab if w not in self.held]
        self.bytes += sum(map(len, new)) + PART_BYTES * len(new)
        column = pa.array(new, pa.large_string())
        lower = pc.and_(pc.ascii_is_alpha(column), pc.ascii_is_lower(column)).to_pylist()
        easy, joined, alone = [], [], []
        for w, ascii_lower in zip(new, lower, strict=True):
            if ascii_lower and self.plain is not None:
                easy.append(w)
            elif self.mark and self.mark in w:
                alone.append(w)
            elif self.plain is not None and w.isalpha() and w == w.lower() and unicodedata.is_normalized("NFC", w):
                easy.append(w)
            else:
                joined.append(w)
        first, size, pool, base = [self.first], [self.size], [self.pool], len(self.pool)
        for tokenizer, parts, step in ((self.plain, easy, TOGETHER if self.mark else 1), (self.tokenizer, joined, TOGETHER if self.mark else 1), (self.tokenizer, alone, 1)):
            for a in range(0, len(parts), AT_ONCE):  # the library's own results take far more room than the ids
                some = parts[a : a + AT_ONCE]
                lists = [e.ids for e in tokenizer.encode_batch_fast([self.mark.join(some[b : b + step]) for b in range(0, len(some), step)], add_special_tokens=False)]
                if step == 1:
                    n = np.array([len(x) for x in lists], np.int64)
                    ids = np.array([i for x in lists for i in x], np.uint32)
                    begin = np.cumsum(n) - n
                else:
                    ids = np.concatenate([np.array([*x, self.mark_id], np.uint32) for x in lists])
                    ends = np.flatnonzero(ids == self.mark_id)
                    begin = np.concatenate([[0], ends[:-1] + 1])
                    n = ends - begin
                first.append(base + begin)
                size.append(n)
                pool.append(ids)
                base += len(ids)
        self.first, self.size, self.pool = np.concatenate(first).astype(np.int64), np.concatenate(size), np.concatenate(pool)
        self.held.update(zip(easy + joined + alone, range(len(self.held), len(self.held) + len(new)), strict=True))
        return np.fromiter((self.held[w] for w in vocab), np.int64, len(vocab))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, flat, each text's followed by the end id; the texts' offsets."""
        flat, off = self.parts_of(texts)
        idx, vocab = coded(flat)
        part = self.number(vocab.to_pylist())[idx]
        n = self.size[part]
        upto = np.concatenate([[0], np.cumsum(n)])
        out_off = upto[off] + np.arange(len(off))  # an end id after each text
        out = np.full(int(out_off[-1]), self.end_id, np.uint32)
        step = np.arange(int(upto[-1]))
        text = np.repeat(np.arange(len(off) - 1), upto[off[1:]] - upto[off[:-1]])
        out[step + text] = self.pool[np.repeat(self.first[part] - upto[:-1], n) + step]
        return out, out_off


#: Tokenizers of this process, with what they hold: a worker keeps them from task to task.
_OWN: dict[tuple[str, int], WordTokenizer] = {}


def own_tokenizer(path: str, end_id: int) -> WordTokenizer:
    if (path, end_id) not in _OWN:
        _OWN[path, end_id] = WordTokenizer(path, end_id)
    return _OWN[path, end_id]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids (then ``end_id``) into pieces of ``capacity``, the last one shorter:
    doc_id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit), and with
    ``with_ids`` the ids. Null and empty texts have one piece, the end id alone. Null ids stay null, repeated rows have pieces each, an
    empty table has none; further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        own = own_tokenizer(tokenizer_path, end_id)
        for batch in slices(batches, chars=CHARS):
            ids, off = own.encode(batch.column("text"))
            n = -(-np.diff(off) // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(off)[row] - start)
            at = off[row] + start
            view = memoryview(ids).cast("B")
            crc = [crc32(view[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array([ids[a : a + m].astype(np.int32) for a, m in zip(at, length, strict=True)], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece, and the room left in each bin. The fitting bin with the least room is
    found in an integer whose bit r says that some bin has room r."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    room: list[int] = []
    mask = 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i] = b
        room[b] = r = r - n
        if r:
            if not by_room[r]:
                mask |= 1 << r
            by_room[r].append(b)
    return bins, np.array(room, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of the bounds of three families of dual-feasible functions (any packing has at
    least as many bins): the sum of sizes; for each threshold t up to half the capacity, sizes above capacity - t count
    as whole bins and sizes under t as nothing; and sizes rounded down to k-ths of a bin."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    total = int((count * sizes).sum())
    best = -(-total // capacity)
    upto, weight = np.cumsum(count), np.cumsum(count * sizes)
    t = np.arange(1, capacity // 2 + 1)
    whole = len(lengths) - upto[capacity - t]
    middle = weight[capacity - t] - weight[t - 1]
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for k in range(2, 21):  # u(k): floor((k + 1) x) / k, and x itself where (k + 1) x is whole
        exact = (k + 1) * sizes % capacity == 0
        u = np.where(exact, sizes * k, (k + 1) * sizes // capacity * capacity)  # in units of 1 / (k capacity)
        best = max(best, -(-int((count * u).sum()) // (k * capacity)))
    return best


PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, gap boolean, room long"


def _pack(capacity: int, base: int):
    """Pack a partition. gap: the partition isn't at its bound and this bin isn't full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        length = table.column("length").to_numpy()
        bins, room = best_fit_decreasing(length, capacity)
        gap = len(room) > lower_bound(length, capacity)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.ones(len(order), bool)
        first[1:] = bins[order][1:] != bins[order][:-1]
        offset = np.zeros(len(order), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.append(np.flatnonzero(first), len(order))))
        ids = base + (np.int64(TaskContext.get().partitionId()) << np.int64(32)) + bins
        for name, values in (("sequence_id", ids), ("offset", offset), ("gap", gap & (room[bins] > 0)), ("room", room[bins])):
            table = table.append_column(name, pa.array(values))
        yield from table.to_batches(max_chunksize=50_000)

    return run


def pack(sized: DataFrame, capacity: int = 4096, part_pieces: int = PART_PIECES) -> DataFrame:
    """Give each row of ``sized (doc_id, piece, start, length, ids_crc32)`` a sequence_id and its
    offset there, gapless from 0; no sequence is longer than ``capacity``. Exchanges go on until one saves no bin, or one
    partition holds what is left.

    Rows are dealt evenly, whatever their keys: ties, repeated rows and null ids are packed like any
    others, each row once. An empty table gives no rows.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rest, done = sized.select(*columns), None
    n, bins = rest.count(), None
    for k in itertools.count():
        parts = max(1, -(-n // part_pieces))
        packed = cut(rest.repartition(parts).mapInArrow(_pack(capacity, k << 52), PACKED))
        last = parts == 1
        kept = packed if last else packed.where(~F.col("gap"))
        kept = kept.select(*columns, "sequence_id", "offset")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        rest = packed.where("gap").select(*columns)
        before, bins = bins, packed.where("gap").agg(F.count_distinct("sequence_id")).first()[0]
        n = rest.count()
        if not n:
            break
        if before is not None and bins >= before:
            done = done.unionByName(packed.where("gap").select(*columns, "sequence_id", "offset"))
            break
    return done


def materialise(docs: DataFrame, packed: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """The sequences themselves: sequence_id and ids, for the plan that ``pack`` made of these ``docs``."""
    cuts = pieces(docs, tokenizer_path, capacity, end_id, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").dropDuplicates(["doc_id", "piece", "ids_crc32"])
    placed = packed.join(cuts.withColumnsRenamed({"doc_id": "_id", "piece": "_piece", "ids_crc32": "_crc"}), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("piece") == F.col("_piece")) & (F.col("ids_crc32") == F.col("_crc")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
