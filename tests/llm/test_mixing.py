import math
from collections import defaultdict

from lexmill.llm import mixing

from .conftest import corpus, frame, sentence


def waterfill(sizes, weights, most=3):
    """Targets by capping again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def documents(rng):
    rows = [(d, t, None, rng.choice(["b", "a", "c", "é", None])) for d, t in corpus(rng)]
    rows += [(1000 + i, sentence(rng, rng.randrange(1, 60)), None, "hot") for i in range(150)]
    return rows + [(2000, "one two", None, "tiny"), (2001, "", None, "void"), (2002, None, None, "void")]


def test_targets_and_prefix(spark, rng):
    rows = documents(rng)
    got = mixing.plan(frame(spark, rows), [1.0, 2.0, 3.0], range_rows=20, split_last=True).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r["size"]
    expected = waterfill(sizes, [1, 2, 3])
    by = defaultdict(list)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, expected[r.source], abs_tol=1e-6) and r.taken <= 3 * r["size"]
        by[r.source].append(r)
    for s, own in by.items():
        assert abs(sum(r.taken for r in own) - expected[s]) <= 1
        full = int(expected[s] // sizes[s]) if sizes[s] else 0
        assert all(r.taken >= full * r["size"] for r in own)


def test_whole_documents_by_key_order(spark, rng):
    rows = [(i, sentence(rng, rng.randrange(1, 60)), None, "ab"[i % 2]) for i in range(80)]
    a = mixing.plan(frame(spark, rows), [1.0, 3.0], range_rows=7).collect()
    b = mixing.plan(frame(spark, rows), [1.0, 3.0], range_rows=10_000).collect()
    key = lambda r: (r.doc_id, r.copies, r.taken)
    assert sorted(map(key, a)) == sorted(map(key, b))  # whatever the ranges, and again
    for s in "ab":
        own = [r for r in a if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r["size"] for r in own) / 2


def test_better_documents_come_first(spark):
    rows = [(i, ("good words only " * 5) if i % 2 else ("###$$$ 123 " * 5), None, "s" if i < 400 else "other") for i in range(800)]
    got = mixing.plan(frame(spark, rows), [1.0, 3.0]).collect()
    once = [r for r in got if r.source == "other" and r.copies]
    assert sum(r.doc_id % 2 for r in once) > len(once) * 0.5


def test_mix_repeats_rows(spark):
    rows = [(1, "a b c d", "en", "x"), (2, "e f", "en", "y"), (None, None, None, None)]
    out = mixing.mix(frame(spark, rows), [1.0, 50.0, 1.0])
    assert out.columns == frame(spark, rows).columns
    counts = defaultdict(int)
    for r in out.collect():
        counts[r.doc_id] += 1
    assert counts[2] == 3 and counts[None] == 1
    assert mixing.mix(frame(spark, []), [1.0]).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
