import re

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lexmill.llm import phrases

from .conftest import corpus, frame, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(doc_id, text) -> (words, kept) with every window looked up in all earlier ones. Rows of one id are one document."""
    key = lambda d: 2**63 - 1 if d is None else d
    docs = sorted({(key(d), tuple(WORD.findall(t or ""))) for d, t in rows})
    first = {}
    for d, w in docs:
        for i in range(len(w) - 19):
            first[w[i : i + 20]] = min(first.get(w[i : i + 20], (d, i)), (d, i))
    out = {}
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if first[w[i : i + 20]] < (d, i):
                gone[i : i + 20] = [True] * 20
        out[d, w] = [x for x, g in zip(w, gone, strict=True) if not g]
    return out, key


@pytest.mark.parametrize("block, fan", [(2_000_000, 1024), (3_000, 1024), (1_000, 3)])
def test_against_all_windows(spark, rng, block, fan):
    rows = corpus(rng)
    passage = sentence(rng, 45)
    rows += [(500 + i, " ".join(passage.split()[i : i + 30]) + " " + sentence(rng, 5) + " " + passage) for i in range(8)]
    rows += [(600, "w " * 50), (601, "w " * 19), (602, "w " * 20), (603, "w " * 21)]
    expected, key = brute(rows)
    got = phrases.remove_repeats(frame(spark, rows), block, 100, fan).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(key(d), []).append(tuple(WORD.findall(t or "")))
    for r in got:
        options = [w for w in texts[key(r.doc_id)] if len(w) == r.n_words]
        assert any((len(w) - len(expected[key(r.doc_id), w]), " ".join(expected[key(r.doc_id), w])) == (r.n_removed, r.kept) for w in options)


def test_empty(spark):
    assert phrases.remove_repeats(frame(spark, [])).count() == 0
    assert [(r.n_words, r.kept) for r in phrases.remove_repeats(frame(spark, [(1, None)])).collect()] == [(0, "")]


@pytest.fixture
def no_task(monkeypatch):
    """A task's number, outside Spark."""
    monkeypatch.setattr(phrases, "TaskContext", type("One", (), {"get": classmethod(lambda c: c), "partitionId": classmethod(lambda c: 0)}))


def test_a_hot_anchor_and_copies_in_a_block(no_task, rng, monkeypatch):
    monkeypatch.setattr(phrases, "HOT", 5)
    passage = sentence(rng, 26)
    rows = [(i, f"{sentence(rng, 12)} {passage if i % 3 else ' '.join(passage.split()[4:25])} {sentence(rng, 12)}") for i in range(60)]
    rows += [(100 + i, passage) for i in range(9)] + [(3, rows[3][1])]
    expected, key = brute(rows)
    blob = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})
    got = local(blob, 900)
    assert [(n, k) for _, n, k in got] == [(len(w) - len(expected[key(d), w]), " ".join(expected[key(d), w])) for d, w in ((d, tuple(WORD.findall(t))) for d, t in rows)]


def local(table, block):
    """The steps without Spark, in one bucket and home: (doc_id, n_removed, kept) by row."""
    blocks = pa.Table.from_batches(phrases._blocks(iter(table.to_batches(max_chunksize=7)), block))
    homes = blocks.column("home").to_pylist()
    gather = lambda tables: pa.concat_tables([phrases.Records().dealt(1), *tables])
    only = lambda t, kinds: t.filter(pc.is_in(t["kind"], pa.array(kinds, pa.int32())))
    recurring = phrases._recurring(1)(gather(pa.Table.from_batches([b]) for b in phrases._send_anchors(1)(iter(blocks.to_batches()))))
    found = phrases._locate(1, 200)(phrases._send_segments(1)(blocks, recurring))
    out = [phrases._keep(b, a) for _, b, a in phrases._blocks_of(blocks, gather([found, only(recurring, [4])]))]
    assert len(out) == len(homes)
    kept = pa.concat_tables(out)
    return list(zip(*(kept.column(c).to_pylist() for c in ("doc_id", "n_removed", "kept")), strict=True))


def test_the_automata_locate_the_occurrences(no_task, rng, monkeypatch):
    passage = sentence(rng, 40)
    table = pa.table({"doc_id": pa.array(range(6), pa.int64()), "text": [f"{sentence(rng, 5)} {passage} {sentence(rng, 5)}" for _ in range(6)]})
    assert [n for _, n, _ in local(table, 100)] == [0, 40, 40, 40, 40, 40]
    match = phrases.automaton_matches
    monkeypatch.setattr(phrases, "automaton_matches", lambda stream, passages: match(stream, passages)[:0])
    assert [n for _, n, _ in local(table, 100)] == [0] * 6
