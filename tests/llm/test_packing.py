import struct
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import packing
from lexmill.llm.queries import tokenizer_path

from .conftest import corpus, frame

public = pytest.importorskip("public_tokenizers")


def check_packed(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_plan(spark, rng):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = corpus(rng) + [(900, "Don't SHOUT'S, it's <|endoftext|> x<|startoftext|>y"), (901, "<|ENDOFTEXT|> İstanbul ΑΣ é a̸ ≠ 12ab!!..")]
    expected = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        expected += [(d, p // 4096, p, len(ids[p : p + 4096]), zlib.crc32(struct.pack(f"<{len(ids[p : p + 4096])}I", *ids[p : p + 4096]))) for p in range(0, len(ids), 4096)]
    sized = packing.pieces(frame(spark, rows), tokenizer_path())
    packed = packing.pack(sized).collect()
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in packed)
    assert check_packed(packed, 4096) == max(packing.lower_bound(np.array([e[3] for e in expected]), 4096), 1)
    # the sequences themselves hold the ids
    plan = packing.pack(sized)
    whole = {r.sequence_id: r.ids for r in packing.materialise(frame(spark, rows), plan, tokenizer_path()).collect()}
    for r in plan.collect():
        own = whole[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(struct.pack(f"<{len(own)}I", *own)) == r.ids_crc32


def test_exchange_between_partitions(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 900, 3000)
    sized = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(sized, 1000, part_pieces=400).collect()
    assert len(packed) == 3000
    assert check_packed(packed, 1000) <= len(packing.best_fit_decreasing(lengths, 1000)[1]) * 1.02


def test_empty(spark):
    assert packing.pack(packing.pieces(frame(spark, []), tokenizer_path())).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=40))
def test_best_fit_and_bound(lengths):
    n = np.array(lengths, np.int64)
    bins, room = packing.best_fit_decreasing(n, 50)
    used = np.bincount(bins, weights=n, minlength=len(room))
    assert (used <= 50).all() and (50 - used == room).all()
    bound = packing.lower_bound(n, 50)
    assert -(-int(n.sum()) // 50) <= bound <= len(room)


def test_bound_is_below_the_optimum():
    # nine pieces of 26 never share a bin of 50; with 25s they pair up
    assert packing.lower_bound(np.array([26] * 9), 50) == 9
    assert packing.lower_bound(np.array([25] * 8), 50) == 4
    assert packing.lower_bound(np.array([17] * 6), 50) == 3


def test_words_are_encoded_as_in_the_whole_text():
    t = packing.WordTokenizer(tokenizer_path(), 1)
    texts = ["Crème brûlée, naïve—yes! x.y,z", "ÀÉ é́ ﬁ ǅ 東京", None, ""]
    ids, off = t.encode(pa.array(texts, pa.string()))
    for i, x in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == [*t.tokenizer.encode(x or "", add_special_tokens=False).ids, 1]


def test_a_slice_takes_no_room_for_the_rest_of_its_batch():
    own = packing.WordTokenizer(tokenizer_path(), 1)
    texts = pa.array([f"Some Words, {i} " * 4_000 for i in range(200)])
    tracemalloc.start()
    try:
        parts, off = own.parts_of(texts.slice(198, 2))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert parts.to_pylist() == ["some", "words", ",", "198"] * 4_000 + ["some", "words", ",", "199"] * 4_000 and off.tolist() == [0, 16_000, 32_000]
    assert most < 4_000_000 < texts.nbytes


def test_parts_encoded_in_several_calls(monkeypatch):
    rows = pa.array([" ".join(f"Wörd{i}x word{chr(97 + i % 26)}{chr(97 + i // 26)}." for i in range(a, a + 60)) for a in range(0, 600, 40)], pa.large_string())
    whole = packing.WordTokenizer(tokenizer_path(), 1).encode(rows)
    for name in ("TOGETHER", "AT_ONCE"):
        monkeypatch.setattr(packing, name, 10)
    few = packing.WordTokenizer(tokenizer_path(), 1).encode(rows)
    assert all((a == b).all() for a, b in zip(whole, few, strict=True))
