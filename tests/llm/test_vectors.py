import math

import numpy as np
import pytest

from lexmill.llm import ann, nndescent

SCHEMA = "vec_id long, embedding array<float>, label int, score string, id string, n string, vector string"
ODD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [1.0, None] + [0.0] * 14, 1), (9004, [math.nan] * 16, 1), (9005, [math.inf] * 16, 1), (9006, [1.0] * 3, 1), (9007, [], 1)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "x", "x", "x") for i, v, label in rows], SCHEMA)


def test_ann_recall_scores_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 150)
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 16)).astype(np.float32)
    x[100:140] = x[100]  # a crowd of equal vectors
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + ODD + [(None, [1.0] * 16, 0)]
    got = ann.search(table(spark, rows)).collect()
    x = x.astype(float)
    by = {}
    for r in got:
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), abs=1e-12) and r.vec_id != r.query_id
        by.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    assert sorted(by) == list(range(0, 900, 20))
    hits = 0
    for q, own in by.items():
        own.sort()
        assert [o[0] for o in own] == list(range(1, 21)) and own == sorted(own, key=lambda o: o[1:])
        s = (x[q] * x).sum(1)
        s[q] = -np.inf
        hits += len({o[2] for o in own} & set(np.lexsort((np.arange(900), -s))[:20].tolist()))
    assert hits / (20 * len(by)) >= 0.95
    assert [o[2] for o in sorted(by[100])] == list(range(101, 121))


def test_ann_few_and_none(spark):
    got = ann.search(table(spark, [(0, [1.0] * 16, 0), (1, [2.0] * 16, 0), (20, [3.0] * 16, None), (0, [1.0] * 16, 0)])).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 20), (0, 2, 1), (20, 1, 1), (20, 2, 0)]
    assert ann.search(table(spark, [])).count() == 0 and ann.search(table(spark, ODD)).count() == 0


def brute(rows, threshold=0.93):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and len(v) == 16 and all(c is not None and math.isfinite(c) for c in v) and any(v):
            good[i] = (label, np.array(v, float))
    parent, links = {i: i for i in good}, dict.fromkeys(good, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(good)
    for a in ids:
        for b in ids:
            if a < b and good[a][0] == good[b][0]:
                x, y = good[a][1], good[b][1]
                if (x * y).sum() / math.sqrt((x * x).sum() * (y * y).sum()) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (links.get(i, 0), find(i) if i in good else i) for i, _, _ in rows}


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist(), int(i % 3)) for i in range(150)]
    base = np.array(rows[5][1])
    rows += [(200 + i, (base + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist(), 2) for i in range(60)]  # a crowd
    rows += [(300 + i, rows[9][1], 0) for i in range(20)] + [(400, (2 * np.array(rows[9][1])).tolist(), 0), (401, rows[9][1], 1), (402, rows[9][1], None)]
    rows += [(500 + i, (np.array(rows[20 + i][1]) + 0.08 * rng.standard_normal(16)).astype(np.float32).tolist(), rows[20 + i][2]) for i in range(15)]
    rows += ODD
    expected = brute(rows)
    got = nndescent.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == expected[r.vec_id] and r.kept == (r.vec_id == r.component_id)
    assert got[0].audit_recall == 1.0


def test_near_duplicates_edges(spark):
    assert nndescent.near_duplicates(table(spark, [])).count() == 0
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in nndescent.near_duplicates(table(spark, [*ODD, (None, [1.0] * 16, 1), (1, [1.0] * 16, 1), (1, [1.0] * 16, 1)])).collect()}
    assert (1, 1, 1, True) in got and (None, 0, None, True) in got and (9001, 0, 9001, True) in got


def test_tables_follow_the_label_and_the_threshold():
    for size in (2_000, 10_000, 100_000, 10**6, 10**9):
        for threshold in (0.5, 0.93, 0.99):
            bits, tables = nndescent.tables_for(size, threshold)
            assert (1 - (1 - math.acos(threshold) / math.pi) ** bits) ** tables <= nndescent.MISS + 1e-12
    assert nndescent.tables_for(2_000, 0.93) == (0, 1) and nndescent.tables_for(10**6, -1.0) == (0, 1)


def test_near_duplicates_in_a_hot_label_and_a_crowded_bucket(spark, monkeypatch):
    for name, value in (("WHOLE", 64), ("PART", 32), ("BUCKET", 8)):
        monkeypatch.setattr(nndescent, name, value, raising=False)
    rng = np.random.default_rng(3)
    small = [(10_000 + i, rng.standard_normal(16).astype(np.float32).tolist(), 1 + i) for i in range(300)]  # labels of one vector
    centre = rng.standard_normal(16)
    x = centre / np.linalg.norm(centre) + 0.16 * rng.standard_normal((400, 16))  # near each other, few of them links
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)] + small
    rows += [(500 + i, (np.array(rows[7 * i][1]) + 0.04 * rng.standard_normal(16)).astype(np.float32).tolist(), 0) for i in range(50)]
    expected = brute(rows)
    got = nndescent.near_duplicates(table(spark, rows)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == expected and got[0].audit_recall == 1.0


@pytest.mark.parametrize("part", [2048, 8])
def test_near_duplicates_keep_a_link_between_crowds_whose_lists_are_full(spark, monkeypatch, part):
    monkeypatch.setattr(nndescent, "PART", part)
    rng = np.random.default_rng(4)

    def at(degrees, noise):
        v = np.concatenate([[math.cos(math.radians(degrees)), math.sin(math.radians(degrees))], noise])
        return v.astype(np.float32).tolist()

    rows = []
    for label, (a, b) in enumerate([(2.5, 21.5), (1.0, 23.0)]):  # one link between two crowds; none
        for crowd, (centre, edge) in enumerate([(0, a), (24, b)]):
            rows += [(100 * label + 50 * crowd + i, at(centre, 0.02 * rng.standard_normal(14)), label) for i in range(20)]
            rows += [(100 * label + 50 * crowd + 20, at(edge, [0.0] * 14), label)]
    expected = brute(rows)
    assert expected[20] == (21, 0) and expected[70] == (21, 0) and expected[170][1] == 150  # nearer to 20 of its own crowd than to the other
    got = nndescent.near_duplicates(table(spark, rows)).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == expected


def test_saturated_stays_saturated_in_longer_lists(spark):
    nodes = spark.createDataFrame([(i, "a", 1, np.array([1.0, 0.01 * i]).tobytes()) for i in range(6)], "id long, label string, n long, vector binary")
    lists = spark.createDataFrame([(0, 1, 0.99995), (1, 0, 0.99995), (2, 3, 0.99995), (3, 2, 0.99995), (4, 5, 0.99995), (5, 4, 0.99995)], "u long, v long, sim double")
    _, full = nndescent._links(nodes, lists, 1, 0.93)
    assert full.count() == 6
    found, full = nndescent._links(nodes, lists, 2, 0.93, full)
    assert full.count() == 6 and {tuple(r) for r in found.select("id", "links", "component").collect()} == {(i, 5, 0) for i in range(6)}


def test_recall_counts_each_vector_the_same(spark):
    true = spark.createDataFrame([(1, 1000), (2, 1), (3, 1), (4, 2)], "id long, true long")
    found = spark.createDataFrame([(1, 1000, 1), (4, 1, 4)], "id long, links long, component long")
    assert nndescent._recall(true, found) == pytest.approx(1.5 / 4)
