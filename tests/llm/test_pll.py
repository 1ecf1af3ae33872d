import numpy as np
import pyarrow as pa

from lexmill.llm import pll
from lexmill.llm.shared import words_of

from .conftest import corpus, frame


def test_learns_order_from_both_sides(spark, rng):
    cycle = "one two three four five six seven".split()
    docs = [(i, " ".join(cycle[(i + j) % 7] for j in range(300))) for i in range(200)]
    net = pll.fit(frame(spark, docs), every=2)
    shuffled = docs[0][1].split()
    rng.shuffle(shuffled)
    got = {r.doc_id: r for r in pll.score(frame(spark, [(1, docs[0][1]), (2, " ".join(shuffled)), (3, None), (4, ""), (None, "one two")]), net).collect()}
    assert got[1].mean_log_likelihood > got[2].mean_log_likelihood + 0.5
    assert (got[3].n_words, got[3].log_likelihood, got[4].mean_log_likelihood) == (0, 0.0, 0.0) and got[None].n_words == 2
    again = pll.fit(frame(spark, docs), every=2)
    assert np.array_equal(net.flat(), again.flat())


def block(texts):
    return pll.Block.of(pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.large_string()))


def plain(net, line, at):
    """log p(symbol | both sides) of one place, from the definition: every symbol's probability, one at a time."""
    z = net.bias.astype(float)
    for k, d in enumerate((*range(-pll.SIDE, 0), *range(1, pll.SIDE + 1))):
        z = z + net.place[k][line[at + d]]
    h = np.tanh(z)
    groups = [float(np.exp(sum(h[i] * net.top[i, g] for i in range(pll.HIDDEN)) + net.top_bias[g])) for g in range(pll.GROUPS)]
    p = []
    for g in range(pll.GROUPS):
        own = [float(np.exp(sum(h[i] * net.out[g, i, j] for i in range(pll.HIDDEN)) + net.out_bias[g, j])) for j in range(pll.WIDTH)]
        p += [groups[g] / sum(groups) * x / sum(own) for x in own]
    assert np.isclose(sum(p), 1)
    return np.log(p[line[at]])


def test_edges_and_probabilities(spark, rng):
    rows = corpus(rng)
    net = pll.fit(frame(spark, rows))
    assert pll.score(frame(spark, rows), net).count() == len(rows)
    assert pll.score(frame(spark, []), pll.fit(frame(spark, []))).count() == 0
    b = block(["a b c", None, "d"])
    line, at = net.windows(net.symbols(b)[b.idx], b.off)
    assert (line[[0, 1, 2, 6, 7, 8]] == 0).all() and len(at) == 4
    assert np.allclose(net.log_probabilities(line, at), [plain(net, line, x) for x in at], atol=1e-5)


def test_softmax_of_columns():
    x = np.random.default_rng(2).standard_normal((32, 7)).astype(np.float32) * 20
    e = np.exp(x.astype(float) - x.max(0))
    assert np.allclose(pll._softmax(x.copy()), e / e.sum(0), atol=1e-6)
    row = np.arange(7) * 4
    assert np.allclose(pll._own(x.copy(), row), np.log((e / e.sum(0))[row, np.arange(7)]), atol=1e-4)


def test_gradient():
    rng = np.random.default_rng(0)
    net = pll.Network.new(np.zeros(pll.BUCKETS, np.int32))
    line = np.concatenate([np.zeros(3, np.int32), rng.integers(1, pll.SYMBOLS, 50).astype(np.int32), np.zeros(3, np.int32)])
    at = np.arange(3, 53)
    before = net.log_probabilities(line, at).mean()
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for t in range(30):
        net.train(line, at, state, t)
    assert net.log_probabilities(line, at).mean() > before + 1


def test_scores_every_word_of_the_corpus(spark, rng, monkeypatch):
    for name in ("SHARD_BYTES", "BLOCK_BYTES", "HELD"):
        monkeypatch.setattr(pll, name, 500, raising=False)
    rows = [r for r in corpus(rng) if r[1]] + [(600, "zq"), (601, "one zzzzq"), *((610 + i, "two wwwzq") for i in range(9))]
    rows += [(700 + i, " ".join(f"filler{k}" for k in range(1500))) for i in range(12)]  # more than the network knows by name
    net = pll.fit(frame(spark, rows))
    got = {r.doc_id: r.log_likelihood for r in pll.score(frame(spark, [(1, "zzzzq"), (2, "wwwzq"), (3, "nowherezq"), *((1000 + r[0], r[1]) for r in rows if r[0] is not None)]), net).collect()}
    # Alike to the network, nine times as frequent: ends in the same two bytes.
    assert np.isclose(got[2] - got[1], np.log(9)) and np.isclose(got[3], got[1])
    words = [w for _, t in ((r[0], r[1]) for r in rows) for w in words_of(pa.array([t]))[0].to_pylist()]
    n = {w: words.count(w) for w in set(words)}
    every = block([" ".join(n)])
    symbols = net.symbols(every)[every.idx]
    assert np.array_equal(np.bincount(symbols, weights=list(n.values()), minlength=pll.SYMBOLS), net.totals)
    own = block([rows[0][1]])
    line, at = net.windows(net.symbols(own)[own.idx], own.off)
    expected = sum(plain(net, line, x) + np.log(n[w] / (net.totals[line[x]] + 1)) for x, w in zip(at, rows[0][1].split(), strict=True))
    assert np.isclose(got[1000 + rows[0][0]], expected, atol=1e-3)


def test_every_word_is_a_target_at_the_production_value(spark, rng):
    short = [(i, " ".join("one two three four".split()[: 1 + i % 4])) for i in range(40)]
    assert np.abs(pll.fit(frame(spark, short)).out_bias).max() > 0
    for n in range(1, 40):
        place = np.arange(n)
        assert sum(((place + n) % pll.EVERY == turn * pll.EVERY // pll.ROUNDS).astype(int) for turn in range(pll.ROUNDS)).tolist() == [1] * n
    cycle = "one two three four five six seven".split()
    docs = [(i, " ".join(cycle[(i + j) % 7] for j in range(300))) for i in range(200)]
    shuffled = docs[0][1].split()
    rng.shuffle(shuffled)
    got = {r.doc_id: r.mean_log_likelihood for r in pll.score(frame(spark, [(1, docs[0][1]), (2, " ".join(shuffled))]), pll.fit(frame(spark, docs))).collect()}
    assert got[1] > got[2] + 0.5
