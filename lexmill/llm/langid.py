"""Language identification: word-first backoff.

A word that training has seen is scored by its log frequency in each language. For an
unseen word the score comes from its character n-grams, the longest first: the mean log
frequency of those 4-grams (with word ends) that training has seen, without any its
3-grams, then 2-grams, then letters.

Counts cover all training rows. The tables that scoring needs are the most frequent words
and n-grams of each language up to a documented number, so that the model that is broadcast
has a fixed bound whatever the size of the corpus.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import coded, cut, mix64, slices, small, words_of

#: Entries kept per language: words, and n-grams of each length.
MAX_WORDS, MAX_GRAMS = 30_000, 20_000
#: Longest n-gram.
N = 4
#: Added to every count.
ALPHA = 0.5
#: Text characters worked on at a time; the number of distinct words in it bounds memory.
CHARS = 4_000_000
UNKNOWN = "und"


def letter_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-cased runs of letters; then, for each run in each text, its place in that
    array and the text it is in."""
    flat, off = words_of(texts)
    idx, raw = coded(flat)
    runs, run_off = words_of(pc.replace_substring_regex(pc.utf8_lower(raw), r"[^\p{L}]+", " "))
    code, vocab = coded(runs)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(off))
    size = np.diff(run_off)[idx]
    at = np.repeat(run_off[idx], size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size))
    return vocab, code[at], np.repeat(owner, size)


def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with a space before, between and behind them; running number of spaces; each one's word."""
    s = np.frombuffer((" " + " ".join(words.to_pylist()) + " ").encode("utf-32-le"), np.uint32)
    spaces = np.cumsum(s == 32)
    return s, spaces, spaces - 1


def gram_codes(words: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code for each n-gram of the words with a space at both ends, and its word."""
    if len(words) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    s, spaces, word = _points(words)
    m = len(s) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = h * np.uint64(0x100000001B3) + s[j : j + m]
    at = np.flatnonzero(s != 32 if n == 1 else spaces[n - 2 : n - 2 + m] == spaces[:m])  # no space but at the ends
    return mix64(h[at] + np.uint64(n)), word[at]


def word_codes(words: pa.Array) -> np.ndarray:
    """A 64-bit code for each word, from all its code points."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    s, spaces, word = _points(words)
    letters = s != 32
    start = np.flatnonzero(~letters)[:-1]
    own = word[letters]
    place = (np.flatnonzero(letters) - start[own]).astype(np.uint64)
    term = mix64(s[letters].astype(np.uint64) + place * np.uint64(0x9E3779B97F4A7C15))
    ends = np.searchsorted(own, np.arange(len(words)))
    return mix64(np.add.reduceat(term, ends))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, chars=CHARS):
        lang, langs = coded(pc.fill_null(batch.column("lang"), ""))
        vocab, word, text = letter_words(batch.column("text"))
        if len(vocab) == 0:
            continue
        key, n = np.unique(lang[text] * len(vocab) + word, return_counts=True)
        yield pa.RecordBatch.from_arrays([langs.take(pa.array(key // len(vocab))).cast(pa.string()), vocab.take(pa.array(key % len(vocab))).cast(pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: the word itself with its count. Kind n: an n-gram, once for each distinct word with it."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        lang, langs = coded(table.column("lang").combine_chunks())
        words = table.column("word").combine_chunks()
        for k, name in enumerate(langs.to_pylist()):
            own = words.filter(pa.array(lang == k))
            parts = [(0, word_codes(own), table.column("n").to_numpy()[lang == k])]
            for n in range(1, N + 1):
                code, count = np.unique(gram_codes(own, n)[0], return_counts=True)
                parts.append((n, code, count))
            for kind, code, count in parts:
                m = len(code)
                yield pa.RecordBatch.from_arrays([pa.array([name] * m, pa.string()), pa.array(np.full(m, kind, np.int32)), pa.array(code.view(np.int64)), pa.array(count.astype(np.int64))], names=["lang", "kind", "code", "n"])

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 200_000:
            yield from flush(held)
            held, size = [], 0
    if size:
        yield from flush(held)


class Model:
    """Per kind (0: words, n: n-grams) the sorted codes and a row of log frequencies for each."""

    def __init__(self, langs: list[str], prior: np.ndarray, tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.prior, self.tables = langs, prior, tables

    def look_up(self, kind: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, logs = self.tables[kind]
        if not len(keys):
            return np.zeros(len(codes), bool), np.zeros((len(codes), len(self.langs)), np.float32)
        at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
        return keys[at] == codes, logs[at]

    def score_words(self, words: pa.Array) -> np.ndarray:
        """A row of log frequencies for each distinct word; zeros where not even a letter is known."""
        known, out = self.look_up(0, word_codes(words))
        out = np.where(known[:, None], out, np.float32(0))
        left = np.flatnonzero(~known)
        for n in range(N, 0, -1):
            if not len(left):
                break
            code, owner = gram_codes(words.take(pa.array(left)), n)
            seen, logs = self.look_up(n, code)
            owner, logs = owner[seen], logs[seen]
            count = np.bincount(owner, minlength=len(left))
            some = count > 0
            for k in range(len(self.langs)):
                total = np.bincount(owner, weights=logs[:, k], minlength=len(left))
                out[left[some], k] = total[some] / count[some]
            left = left[~some]
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str | None], np.ndarray]:
        vocab, word, text = letter_words(texts)
        n = len(texts)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        logs = self.score_words(vocab)
        total = np.tile(self.prior, (n, 1))
        for k in range(len(self.langs)):
            total[:, k] += np.bincount(text, weights=logs[word, k], minlength=n)
        best = np.argmax(total, 1)
        p = np.exp(total - total.max(1, keepdims=True))
        p = p[np.arange(n), best] / p.sum(1)
        has = np.bincount(text, minlength=n) > 0
        return [self.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.where(has, p, 0.0)


def fit(labelled: DataFrame, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS) -> Model:
    """Learn from ``labelled (text, lang)``. Rows with a null text or lang teach nothing.

    The counts are of all rows; per language the ``max_words`` most frequent words and the
    ``max_grams`` most frequent n-grams of each length reach the model (those whose count ties
    with the first that finds no room stay out), each with its counts in all languages.
    """
    labelled = labelled.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    words = labelled.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = words.mapInArrow(_count_grams, "lang string, kind int, code long, n long").groupBy("lang", "kind", "code").agg(F.sum("n").alias("n"))
    counts = cut(counts.coalesce(max(1, labelled.rdd.getNumPartitions())))  # less than the texts, so in no more files than their parts
    # A count's number of entries, from which the least count that finds room follows: a few thousand rows.
    levels: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for lang, kind, n, rows in counts.groupBy("lang", "kind", "n").agg(F.count("*")).collect():
        levels.setdefault((lang, kind), []).append((n, rows))
    least: Column | None = None
    totals: dict[tuple[str, int], tuple[int, int]] = {}
    for (lang, kind), found in sorted(levels.items()):
        room, floor = (max_grams if kind else max_words), max(n for n, _ in found) + 1
        for n, rows in sorted(found, reverse=True):
            room -= rows
            if room < 0:
                break
            floor = n
        totals[lang, kind] = sum(n * rows for n, rows in found), sum(rows for _, rows in found)
        rule = (F.col("lang") == lang) & (F.col("kind") == kind) & (F.col("n") >= floor)
        least = rule if least is None else least | rule
    if least is None:
        return Model([], np.zeros(0), {n: (np.zeros(0, np.uint64), np.zeros((0, 0), np.float32)) for n in range(N + 1)})
    # Of what is kept for one language, every language's count.
    kept = counts.join(small(cut(counts.where(least).select("kind", "code").distinct(), len(totals) * max(max_words, max_grams))), ["kind", "code"], "left_semi").select("lang", "kind", "code", "n").toArrow()
    langs = sorted({lang for lang, _ in totals})
    tables = {}
    lang_at = np.array([langs.index(x) for x in kept.column("lang").to_pylist()], np.int64)
    kinds, codes, ns = (kept.column(c).to_numpy() for c in ("kind", "code", "n"))
    for kind in range(N + 1):
        own = kinds == kind
        keys, at = np.unique(codes[own].view(np.uint64), return_inverse=True)
        count = np.zeros((len(keys), len(langs)))
        count[at, lang_at[own]] = ns[own]
        size = np.array([totals.get((x, kind), (0, 0)) for x in langs], float)
        tables[kind] = keys, np.log((count + ALPHA) / (size[:, 0] + ALPHA * (size[:, 1] + 1))).astype(np.float32)
    return Model(langs, np.zeros(len(langs)), tables)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` but lang_pred and score, then these two.

    lang_pred is a learned language, and ``und`` with score 0 where the text is null or has
    no letter, or where nothing was learned. score is the posterior probability of the
    prediction. Ties go to the language that is first by code point. Repeated rows have equal
    results; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(held.value)  # noqa: S301  of our own making
        for batch in slices(batches, chars=CHARS):
            lang, score = own.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % 4
