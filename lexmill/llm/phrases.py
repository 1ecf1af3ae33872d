"""Substring deduplication by automata of repeated phrases.

A window is a number of consecutive words of one document. The documents are put into blocks of a
bounded size, and these go through the steps:

1. Every window has an anchor, the least hash among the short phrases in it; equal windows have equal
   anchors, and neighbours mostly share theirs. Blocks exchange their distinct anchors, by ranges of the
   hash, and learn which occur more than once. Documents that repeat an earlier one as a whole are
   found in the same exchange.
2. Neighbouring windows with one such anchor are a segment. Blocks stream the segments of all their documents to the shard of
   their anchor. There the windows that occur more than once are confirmed, and runs of them are the recurring passages.
3. Each shard compiles its passages, whichever block they come from, into Aho-Corasick automata of no more than about ``SHARD`` words,
   and streams the segments of all blocks through them. The matches are the occurrences; the first in the order of documents stays. In an
   automaton's alphabet a word is one character, so that a match is one of whole, equal words.

A block sends each anchor and segment once, however often it has them, and copies what is found in one to the others that it equals,
so that a phrase in every document is no hot group. Windows whose anchor occurs more than ``HOT`` times are segments of their own, dealt by
their own hash, so that a common phrase in many surroundings is none either. What blocks send are records in numpy arrays, gathered and dealt out to buckets by
their key; where there are more buckets than ``FAN``, they are dealt in two steps, so that the pieces stay large however
many blocks and buckets there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import coded, cut, mix64, rolling, slices, starts_within, word_hashes, words_of

#: Words of a window, and of the phrases that its anchor is chosen from; windows of a segment; occurrences of an anchor beyond which it is hot.
WINDOW, PHRASE, SPAN, HOT = 20, 6, 15, 2_000
#: Words of the longest segment.
LONGEST = SPAN + WINDOW - 1
#: Bytes of text in a block, about; words in an automaton; blocks to each bucket of hashes.
BLOCK_BYTES, SHARD, BLOCKS_PER_BUCKET = 2_000_000, 500_000, 3
#: Buckets that one step deals to; records that a task gathers before it deals them; buckets of small inputs; blocks to a task at most, about.
FAN, GATHER, LEAST_BUCKETS, PER_TASK = 1024, 1_500_000, 24, 64
#: Stands for a null doc_id: behind all others.
LAST = np.int64(2**63 - 1)
OTHER = np.uint64(0x9E3779B97F4A7C15)


def _zip(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, each compressed."""
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    parts = [z.compress(np.ascontiguousarray(a).tobytes()) for a in arrays]
    return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts)


ROW = "kind int, bucket long, blob binary"
#: The arrays of each kind of record, and which of them is the key: 0 anchors (hash, home, how often there), 1 documents (hash, hash,
#: home, id, row), 2 segments (anchor, or hash of its one window, home, id, start, place, windows, more than once there, hashes of its words); answers go home: 3 anchors that recur
#: (hash, home, hot), 4 documents that repeat an earlier one (row, home), 5 windows that recur (place, home, first id, first start), 6 segments that
#: equal another of their block (place, home, place of that one, windows).
KINDS = {0: (("u8", "i8", "i4"), 0), 1: (("u8", "u8", "i8", "i8", "i4"), 0), 2: (("u8", "i8", "i8", "i4", "i4", "i4", "?", f"V{8 * LONGEST}"), 0), 3: (("u8", "i8", "?"), 1), 4: (("i4", "i8"), 1), 5: (("i4", "i8", "i8", "i4"), 1), 6: (("i4", "i8", "i4", "i4"), 1)}


class Records:
    """Records of several kinds, gathered."""

    def __init__(self) -> None:
        self.parts: dict[int, list[list[np.ndarray]]] = {k: [] for k in KINDS}
        self.size = 0

    def add(self, kind: int, *arrays: np.ndarray) -> None:
        if len(arrays[0]):
            self.parts[kind].append(list(arrays))
            self.size += len(arrays[0])

    def read(self, table: pa.Table | pa.RecordBatch) -> Records:
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            self.add(kind, *_unzip(blob, *KINDS[kind][0]))
        return self

    def of(self, kind: int) -> list[np.ndarray]:
        kinds = KINDS[kind][0]
        return [np.concatenate([np.zeros(0, k), *(p[i] for p in self.parts[kind])]) for i, k in enumerate(kinds)]

    def dealt(self, buckets: int) -> pa.Table:
        """Rows (kind, bucket, blob), a bucket being the key modulo ``buckets``."""
        rows: list[tuple[int, int, bytes]] = []
        for kind, (_, key) in KINDS.items():
            if self.parts[kind]:
                arrays = self.of(kind)
                bucket = (arrays[key].astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                    rows.append((kind, int(bucket[at[0]]), _zip(*(a[at] for a in arrays))))
        return pa.table({"kind": pa.array([r[0] for r in rows], pa.int32()), "bucket": pa.array([r[1] for r in rows], pa.int64()), "blob": pa.array([r[2] for r in rows], pa.binary())})


def _whole(buckets: int, fan: int) -> int:
    """The number of buckets, as one or two steps of dealing give it."""
    return buckets if buckets <= fan else -(-buckets // fan) * fan


def _dealt_again(rows: DataFrame, buckets: int, fan: int) -> DataFrame:
    """Rows that were dealt to ``fan`` buckets dealt to ``buckets``, if these are more."""
    if buckets <= fan:
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Records()
        for batch in batches:
            held.read(batch)
            if held.size >= GATHER:
                yield from held.dealt(buckets).to_batches()
                held = Records()
        if held.size:
            yield from held.dealt(buckets).to_batches()

    return rows.repartition("bucket", F.pmod(F.xxhash64("blob"), F.lit(max(1, buckets // fan // 64)))).mapInArrow(run, ROW)


def _unzip(blob: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    z, at = zstandard.ZstdDecompressor(), 8 * len(kinds)
    out = []
    for n, kind in zip(np.frombuffer(blob[:at], np.int64).tolist(), kinds, strict=True):
        out.append(np.frombuffer(z.decompress(blob[at : at + n]), kind))
        at += n
    return out


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    import zstandard

    def flush() -> pa.RecordBatch:
        nonlocal number, held, size
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema) as w:
            for b in held:
                w.write_batch(b)
        blob = zstandard.ZstdCompressor(level=6).compress(sink.getvalue())
        number, held, size = number + 1, [], 0
        key = mix64(np.array([(TaskContext.get().partitionId() << 32) + number], np.uint64)) >> np.uint64(1)
        return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array([blob], pa.binary())], names=["home", "blob"])

    number, held, size = 0, [], 0
    for batch in slices(batches, chars=most // 4):
        batch = pa.RecordBatch.from_arrays(pa.Table.from_batches([batch]).combine_chunks().to_batches()[0].columns, schema=batch.schema)
        held.append(batch.take(pa.array(np.arange(batch.num_rows))))  # a copy, not a view of the whole batch
        size += sum(len(x or "") for x in batch.column("text").to_pylist())
        if size >= most:
            yield flush()
    if held:
        yield flush()


class Block:
    """A block's documents in words: ids, flat words, offsets, and a hash of each word."""

    def __init__(self, blob: bytes):
        import zstandard

        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all().combine_chunks()
        self.doc_id = table.column("doc_id")
        self.key = np.array([LAST if x is None else x for x in self.doc_id.to_pylist()], np.int64)
        self.words, self.off = words_of(table.column("text").combine_chunks())
        self.size = np.diff(self.off)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)

    def hashes(self) -> np.ndarray:
        code, vocab = coded(self.words)
        return word_hashes(vocab)[code]

    def window_places(self) -> np.ndarray:
        return np.flatnonzero(starts_within(self.off, WINDOW))


def _sliding(x: np.ndarray, k: int, least) -> np.ndarray:
    """Minimum (or maximum) of each ``k`` consecutive entries."""
    width = 1
    while 2 * width <= k:
        x = least(x[: len(x) - width], x[width:])
        width *= 2
    return x if width == k else least(x[: len(x) - (k - width)], x[k - width :])


def anchors(h: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of the window at each of ``places``, and the hash of each phrase that is an anchor where it stands."""
    grams = rolling(h, PHRASE)
    per = WINDOW - PHRASE + 1
    least = _sliding(grams, per, np.minimum)[places] if len(places) else np.zeros(0, np.uint64)
    at = np.zeros(len(h) + per, np.uint64)  # at each window's place its anchor, else 0
    at[places + per - 1] = least
    most = _sliding(at, per, np.maximum)[: len(grams)] if len(grams) else grams
    return least, grams[(most == grams) & (most > 0)] if len(grams) else grams


def _send_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        out = Records()
        for batch in batches:
            for home, blob in zip(batch.column("home").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                b = Block(blob)
                h = b.hashes()
                found, count = np.unique(anchors(h, b.window_places())[1], return_counts=True)
                rows = np.flatnonzero(b.size >= WINDOW).astype(np.int32)
                whole = np.array([np.frombuffer(xxhash.xxh3_128_digest(h[b.off[i] : b.off[i + 1]].tobytes()), np.uint64) for i in rows], np.uint64).reshape(-1, 2)
                out.add(0, found, np.full(len(found), home), count.astype(np.int32))
                out.add(1, whole[:, 0], whole[:, 1], np.full(len(rows), home), b.key[rows], rows)
                if out.size >= GATHER:
                    yield from out.dealt(buckets).to_batches()
                    out = Records()
        if out.size:
            yield from out.dealt(buckets).to_batches()

    return run


def _starts_of_groups(*sorted_: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in sorted_], axis=0)
    return new


def _recurring(homes: int):
    """Of one bucket: which blocks' anchors recur, and which documents repeat one with a smaller id."""

    def run(table: pa.Table) -> pa.Table:
        got, out = Records().read(table), Records()
        value, home, count = got.of(0)
        if len(value):
            order = np.argsort(value, kind="stable")
            group = np.cumsum(_starts_of_groups(value[order])) - 1
            total = np.bincount(group, weights=count[order])[group]
            many = total > 1
            out.add(3, value[order][many], home[order][many], total[many] > HOT)
        a, b, home, key, row = got.of(1)
        if len(a):
            order = np.lexsort((key, b, a))
            new = _starts_of_groups(a[order], b[order])
            copy = order[key[order] > key[order][np.flatnonzero(new)][np.cumsum(new) - 1]]
            out.add(4, row[copy], home[copy])
        return out.dealt(homes)

    return run


def _blocks_of(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, Block, Records]]:
    """The blocks of a group, each with the answers to it."""
    got = Records().read(right)
    answers = {kind: got.of(kind) for kind in (3, 4, 5, 6)}
    for home, blob in zip(left.column("home").to_pylist(), left.column("blob").to_pylist(), strict=True):
        own = Records()
        for kind, arrays in answers.items():
            mine = arrays[1] == home
            own.add(kind, *(x[mine] for x in arrays))
        yield home, Block(blob), own


def segments(places: np.ndarray, anchor: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring places with one anchor, ``SPAN`` at most, and each of ``alone`` by itself: where in ``places`` each begins, and its windows."""
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] != places[:-1] + 1) | (anchor[1:] != anchor[:-1]) | alone[1:]
    runs = np.flatnonzero(new)
    new |= (np.arange(len(places)) - runs[np.cumsum(new) - 1]) % SPAN == 0
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(places)))


def _send_segments(buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = Records()
        for home, b, answers in _blocks_of(left, right):
            known, _, hot = answers.of(3)
            order = np.argsort(known)
            known, hot = known[order], hot[order]
            places = b.window_places()
            skip = np.zeros(len(b.size), bool)
            skip[answers.of(4)[0]] = True
            places = places[~skip[b.doc[places]]]
            if not len(known) or not len(places):
                continue
            h = b.hashes()
            anchor = anchors(h, places)[0]
            which = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
            some = known[which] == anchor
            places, anchor, alone = places[some], anchor[some], hot[which[some]]
            if not len(places):
                continue
            at, n = segments(places, anchor, alone)
            place, whole = places[at], rolling(h, WINDOW)
            key = np.where(alone[at], whole[place], anchor[at])
            doc = b.doc[place]
            own, start = b.key[doc], (place - b.off[doc]).astype(np.int32)
            ends = whole[place], whole[place + n - 1]  # together all words of a segment
            order = np.lexsort((start, own, n, *ends))
            new = _starts_of_groups(n[order], ends[0][order], ends[1][order])
            first = order[new]
            copies = np.flatnonzero(~new)
            out.add(6, place[order[copies]].astype(np.int32), np.full(len(copies), home), place[first][np.cumsum(new)[copies] - 1].astype(np.int32), n[order[copies]].astype(np.int32))
            multi = np.diff(np.append(np.flatnonzero(new), len(order))) > 1
            by_place = np.argsort(place[first], kind="stable")
            first, multi = first[by_place], multi[by_place]
            for a in range(0, len(first), 50_000):
                f = first[a : a + 50_000]
                within = np.arange(LONGEST) < n[f][:, None] + WINDOW - 1
                words = np.where(within, h[np.minimum(place[f][:, None] + np.arange(LONGEST), len(h) - 1)], np.uint64(0))
                out.add(2, key[f], np.full(len(f), home), own[f], start[f], place[f].astype(np.int32), n[f].astype(np.int32), multi[a : a + 50_000], np.ascontiguousarray(words).view(f"V{8 * LONGEST}").ravel())
        return out.dealt(buckets)

    return run


def _characters(code: np.ndarray) -> np.ndarray:
    """Small numbers as code points that aren't surrogates."""
    return (code + np.where(code >= 0xD800, 0x800, 0)).astype(np.uint32)


def automaton_matches(stream: str, passages: list[tuple[int, int]]) -> np.ndarray:
    """Every occurrence in ``stream`` of the passages, given as ranges of it: rows (end, number of the passage)."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for i, (x, y) in enumerate(passages):
        automaton.add_word(stream[x:y], i)
    automaton.make_automaton()
    return np.fromiter(automaton.iter(stream), np.dtype([("end", np.int64), ("passage", np.int64)]))


def occurrences(words: np.ndarray, off: np.ndarray, multi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where recurring windows occur in segments, given by their flat words and offsets, and which window each is. ``multi``: segments that count twice."""
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    places = np.flatnonzero(starts_within(off, WINDOW))
    h1, h2 = (x[places] for x in _window_hashes(words))
    order = np.lexsort((h2, h1))
    group = np.cumsum(_starts_of_groups(h1[order], h2[order])) - 1
    many = np.bincount(group, weights=1 + multi[owner[places[order]]]) > 1
    window = np.empty(len(places), np.int64)
    window[order] = np.where(many[group], group, -1)
    sure = window >= 0  # confirmed
    if not sure.any():
        return places[:0], window[:0]
    at = places[sure]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    runs = np.flatnonzero(new)
    code, letters = coded(pa.array(words))
    line = np.ones(len(words) + len(off), np.uint32)  # 1: the end of a segment
    line[np.arange(len(words)) + owner] = _characters(code + 2)
    stream = line.tobytes().decode("utf-32-le")
    begin = at[runs]
    n = np.diff(np.append(runs, len(at)))
    shift = begin + owner[begin]
    distinct: dict[str, int] = {}
    for i, (x, y) in enumerate(zip(shift.tolist(), (shift + n + WINDOW - 1).tolist(), strict=True)):
        distinct.setdefault(stream[x:y], i)
    some = np.fromiter(distinct.values(), np.int64, len(distinct))
    found = automaton_matches(stream, list(zip(shift[some].tolist(), (shift[some] + n[some] + WINDOW - 1).tolist(), strict=True)))
    run = some[found["passage"]]
    first = found["end"] - (n[run] + WINDOW - 1) + 1
    step = np.arange(int(n[run].sum())) - np.repeat(np.cumsum(n[run]) - n[run], n[run])
    which = np.full(len(line), -1, np.int64)
    which[np.repeat(first, n[run]) + step] = window[sure][np.repeat(runs[run], n[run]) + step]
    which = which[np.arange(len(words)) + owner]
    located = np.flatnonzero(which >= 0)
    return located, which[located]


def _locate(homes: int, shard: int):
    """Of one bucket: where the windows that recur are, and the first occurrence of each."""

    def run(table: pa.Table) -> pa.Table:
        got, out = Records().read(table), Records()
        out.add(6, *got.of(6))
        anchor, home, key, start, place, n, multi, words = got.of(2)
        order = np.lexsort((place, home, anchor))
        n = n.astype(np.int64)
        upto = np.cumsum(n[order] + WINDOW - 1)
        edges = np.append(np.flatnonzero(_starts_of_groups(anchor[order])), len(order)) if len(order) else np.zeros(1, np.int64)
        a = 0
        while a < len(edges) - 1:  # whole groups of one anchor, of about a shard's words
            base = upto[edges[a] - 1] if edges[a] else 0
            b = max(a + 1, int(np.searchsorted(upto[edges[1:] - 1], base + shard, side="right")))
            seg = order[edges[a] : edges[b]]
            a = b
            size = n[seg] + WINDOW - 1
            off = np.concatenate([[0], np.cumsum(size)])
            table_ = words[seg].view(np.uint64).reshape(-1, LONGEST)
            at, window = occurrences(table_[np.arange(LONGEST) < size[:, None]], off, multi[seg])
            if not len(at):
                continue
            own = np.searchsorted(off, at, side="right") - 1
            step = at - off[own]
            own = seg[own]
            own_start = start[own] + step
            by = np.lexsort((own_start, key[own], window))
            new = _starts_of_groups(window[by])
            head = by[np.flatnonzero(new)][np.cumsum(new) - 1]
            place_ = place[own[by]] + step[by]
            tidy = np.lexsort((place_, home[own[by]]))  # neighbours compress well
            by, head, place_ = by[tidy], head[tidy], place_[tidy]
            out.add(5, place_.astype(np.int32), home[own[by]], key[own[head]], own_start[head].astype(np.int32))
        return out.dealt(homes)

    return run


def _window_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return rolling(h, WINDOW), (rolling(h ^ OTHER, WINDOW, 0x5851F42D4C957F2D) >> np.uint64(32)).astype(np.uint32)


def _keep(b: Block, answers: Records) -> pa.Table:
    total = len(b.words)
    key, start = np.zeros(total, np.int64), np.full(total, -1, np.int32)  # at each place the first occurrence of its window, where it recurs
    place, _, first_key, first_start = answers.of(5)
    key[place], start[place] = first_key, first_start
    copy, _, like, n = answers.of(6)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    to, of = np.repeat(copy, n) + step, np.repeat(like, n) + step
    key[to], start[to] = key[of], start[of]
    places = np.flatnonzero(start >= 0)
    doc = b.doc[places]
    later = places[(b.key[doc] != key[places]) | (places - b.off[doc] != start[places])]
    edge = np.bincount(later, minlength=total + 1) - np.bincount(later + WINDOW, minlength=total + 1)
    gone = np.cumsum(edge)[:-1] > 0
    copies = np.zeros(len(b.size), bool)
    copies[answers.of(4)[0]] = True
    gone |= copies[b.doc]
    kept = np.concatenate([[0], np.cumsum(~gone)])[b.off]
    texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(kept, pa.int64()), b.words.filter(pa.array(~gone))), pa.scalar(" ", pa.large_string()))
    return pa.table({"doc_id": b.doc_id, "n_words": pa.array(b.size, pa.int64()), "n_removed": pa.array(b.size - np.diff(kept), pa.int64()), "kept": texts.cast(pa.string())})


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """One row per row of ``docs (doc_id long, text string, ...)``: doc_id, n_words, n_removed and kept, the words
    left, joined by one space. Removed is every word in a window of ``WINDOW`` words whose words also start
    earlier: in a document of smaller doc_id, or earlier in the same one.

    Null and empty texts: no words, kept is empty. A null doc_id comes behind all others. Rows that repeat a
    doc_id are one document: equal windows at equal places in them aren't earlier than each other. An empty
    table gives no rows. Further columns are ignored.
    """
    blocks = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda batches: _blocks(batches, block_bytes), "home long, blob binary"))
    n = blocks.count()
    homes = _whole(max(1, n), fan)
    buckets = _whole(max(1, min(n, LEAST_BUCKETS), n // BLOCKS_PER_BUCKET), fan)
    first = min(buckets, fan)
    blocks = blocks.withColumn("bucket", F.col("home") % homes)

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        return pa.concat_tables([empty, *(_keep(b, answers) for _, b, answers in _blocks_of(left, right))])

    parts = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // PER_TASK)
    by = lambda df: df.repartition(parts, "bucket")
    sent = _dealt_again(blocks.mapInArrow(_send_anchors(first), ROW), buckets, fan)
    recurring = cut(_dealt_again(by(sent).groupBy("bucket").applyInArrow(_recurring(min(homes, fan)), ROW), homes, fan))
    streamed = by(blocks).groupBy("bucket").cogroup(by(recurring).groupBy("bucket")).applyInArrow(_send_segments(first), ROW)
    found = by(_dealt_again(streamed, buckets, fan)).groupBy("bucket").applyInArrow(_locate(min(homes, fan), shard), ROW)
    answers = _dealt_again(found, homes, fan).unionByName(recurring.where("kind = 4"))
    blocks, answers = by(blocks), by(answers)
    return blocks.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")
