import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm import minhash
from lexmill.llm.shared import components

from .conftest import corpus, frame, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(minhash.UPPER, minhash.LOWER)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = {}
    for d, t in rows:
        if d is not None:
            sets[d] = shingles(t, k)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("k", [4, 5])
def test_against_all_pairs(spark, rng, k):
    rows = corpus(rng)
    got = minhash.near_duplicates(frame(spark, rows), shingle=k).collect()
    assert len(got) == len(rows)
    expected = brute(rows, k, 80)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*expected[r.doc_id], expected[r.doc_id][1] == r.doc_id)


def test_group_whose_leader_is_not_like_all(spark, rng, monkeypatch):
    """A crowd of near copies where the smallest id links to few: the blocks must find the rest."""
    monkeypatch.setattr(minhash, "PARTS", 2)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    base = sentence(rng, 120, 10_000).split()
    rows = []
    for i in range(60):
        w = list(base)
        for j in range(rng.randrange(1, 9)):
            w[rng.randrange(120)] = f"edit{i}x{j}"
        rows.append((i, " ".join(w)))
    expected = brute(rows, 4, 80)
    for r in minhash.near_duplicates(frame(spark, rows), shingle=4).collect():
        assert r.component_id == expected[r.doc_id][1]


def test_empty_table(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    assert minhash.near_duplicates(frame(spark, [(1, None), (2, "")])).count() == 2


def test_bounds_keep_similar_pairs():
    rng = np.random.default_rng(0)
    bounds = minhash.floors(0.8, 1e-7)
    a = rng.integers(0, 2**16, (20_000, minhash.N_HASHES)).astype(np.uint16)
    b = np.where(rng.random(a.shape) < 0.8, a, a + 1).astype(np.uint16)
    assert len(minhash.sequential(a, b, bounds)) == len(a)
    c = np.where(rng.random(a.shape) < 0.4, a, a + 1).astype(np.uint16)
    assert len(minhash.sequential(a, c, bounds)) < 5


def test_signatures_estimate_similarity():
    x = np.arange(2000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    both = np.concatenate([x[:1500], x[500:]])
    s = minhash.signatures_of(both, np.array([0, 1500, 3000]))
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.15
    sets, off = minhash.shingle_sets(pa.array(["A b c", None, "", "a B C d e"]), 4)
    assert np.diff(off).tolist() == [1, 0, 0, 2]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(50)}}


def test_a_slice_takes_no_room_for_the_rest_of_its_batch():
    texts = pa.array([f"Some Words, {i} " * 4_000 for i in range(200)], pa.large_string())
    tracemalloc.start()
    try:
        x, off = minhash.shingle_sets(texts.slice(198, 1), 5)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    same, _ = minhash.shingle_sets(pa.array(["some words, 198 " * 4_000]), 5)
    assert x.tolist() == same.tolist() and off.tolist() == [0, 3]
    assert most < 4_000_000 < texts.nbytes
