import random

import pytest

from lexmill.errors import InvalidArgument, InvalidState, SearchCursorError, UnsupportedAnalyzer
from lexmill.functions import bm25
from lexmill.functions.analysis import FunctionAnalyzer, SimpleAnalyzer, Token
from lexmill.functions.osa import auto_edits, osa_distance
from lexmill.operators import fuzzy, indexes, textindex
from lexmill.operators.execute import Searcher
from lexmill.operators.highlight import fragments, merged
from lexmill.plans import predicates as p
from lexmill.plans import ranked as r
from lexmill.plans.evaluate import Document, evaluate
from lexmill.plans.requests import HighlightedSearchRequest, SearchPageRequest, SearchRequest, TotalHitsMode
from lexmill.schema import Field, IndexType, SearchSchema, TextField

WORDS = ["java", "search", "engine", "café", "東京", "serach", "jav"]


def over(spark, bodies, groups=None, **more):
    rows = [(i, b, (groups or ["x"] * len(bodies))[i]) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "id long, body string, grp string")
    s = Searcher.over(df, SearchSchema.from_frame(df, "id", ("body",), **more))
    return s, s.schema.text_field("body")


def found(df):
    return [(x.id, x.score) for x in df.select("id", "score").collect()]


def test_analysis_is_the_same_on_driver_and_in_spark(spark):
    a = SimpleAnalyzer()
    texts = ["Café 東京, x２ naïve", "ＦＵＬＬ width ﬁne", "A-b_c 1½ ǅ", "", None, "Ⅳ ΑΣ"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    rows = df.select("id", a.column(df.t).alias("k")).orderBy("id").collect()
    assert [[(k.term, k.pos) for k in row.k] for row in rows] == [[(t.term, i) for i, t in enumerate(a.tokens(x))] for x in texts]
    t = a.tokens("x\U0001f600 ﬁne ét")
    assert [(k.term, k.start, k.end) for k in t] == [("x", 0, 1), ("fine", 4, 7), ("ét", 8, 11)]


def test_bm25_values(spark):
    s, body = over(spark, ["java java search", "java engine", "search engine engine engine", None, "---"])
    expected = [(0, 1.116258619458622), (1, 0.5442147286003254), (2, 0.4136031937362473)]
    for text in ("java search", "java java search"):
        for (i, score), (j, e) in zip(found(s.top_k(SearchRequest(r.text(body, text)))), expected, strict=True):
            assert i == j and score == pytest.approx(e, abs=1e-12)


def test_phrase_and_slop(spark):
    s, body = over(spark, ["alpha beta", "alpha noise beta", "alpha noise noise beta", "beta noise alpha", "alpha only"])
    at = lambda slop: sorted(i for i, _ in found(s.top_k(SearchRequest(r.phrase(body, "alpha beta", slop)))))
    assert (at(0), at(1), at(2), at(10**6)) == ([0], [0, 1], [0, 1, 2], [0, 1, 2])


def test_osa():
    assert osa_distance("teh", "the", 1) == osa_distance("jav", "java", 1) == osa_distance("apple", "applr", 1) == osa_distance("\U0001f600ab", "\U0001f600ba", 1) == 1
    assert osa_distance("abc", "axd", 2) == 2 and osa_distance("abc", "uvwxyz", 2) == 3 and osa_distance("ca", "abc", 3) == 3
    assert [auto_edits("a" * n) for n in (1, 2, 3, 5, 6)] == [0, 0, 1, 1, 2]


def test_fuzzy_expansion_against_brute_force(spark):
    rng = random.Random(6)
    vocab = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(300)})
    df = spark.createDataFrame([(v,) for v in vocab], "term string")
    for term in ("ab", "abca", "abcabc"):
        k = auto_edits(term)
        brute = sorted((d, v) for v in vocab if (d := osa_distance(term, v, k)) <= k)
        assert [(d, t) for t, d in fuzzy.expand(df, term)] == brute


def random_query(rng, body, depth=2):
    kind = rng.randrange(5 if depth else 3)
    text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4)))
    if kind == 0:
        return r.text(body, text)
    if kind == 1:
        return r.phrase(body, text, rng.randrange(3))
    if kind == 2:
        return r.fuzzy(body, rng.choice(WORDS))
    if kind == 3:
        return random_query(rng, body, depth - 1).boost(rng.choice([0.5, 2.0]))
    b = r.bool_()
    must, should = rng.randrange(3), rng.randrange(1, 3)
    for _ in range(must):
        b.must(random_query(rng, body, depth - 1))
    for _ in range(should):
        b.should(random_query(rng, body, depth - 1))
    if rng.random() < 0.5:
        b.minimum_should_match(rng.randrange(0 if must else 1, should + 1))
    return b.build()


def test_scan_postings_and_python_agree(spark, tmp_path):
    rng = random.Random(5005)
    bodies = [None if rng.random() < 0.05 else " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 9))) for _ in range(50)]
    s, body = over(spark, bodies)
    indexes.build(s.df, indexes.IndexDefinition(body, IndexType.TEXT), str(tmp_path / "i"))
    registry = indexes.IndexRegistry()
    registry.add(indexes.IndexDefinition(body, IndexType.TEXT), str(tmp_path / "i"))
    stored = Searcher(s.df, s.schema, registry)
    for _ in range(12):
        request = SearchRequest(random_query(rng, body), limit=1000)
        node = s.normalised(request)
        stats = {} if r.is_empty(node) else s.statistics(node)
        expected = []
        for i, b in enumerate(bodies):
            e = evaluate(node, Document({body: body.analyzer.tokens(b)}), stats, request.config)
            if e.matched:
                expected.append((i, e.score))
        expected.sort(key=lambda x: (-x[1], x[0]))
        assert found(s.top_k(request)) == expected
        assert found(stored.top_k(request)) == expected


@pytest.mark.parametrize("analyzer", [SimpleAnalyzer(), FunctionAnalyzer(str.split)])
def test_postings_against_python(spark, monkeypatch, analyzer):
    rng = random.Random(4)
    bodies = [None, "", "a b a", "c c c", *(" ".join(rng.choice(["a", "bb", "東京", "d"]) for _ in range(rng.randrange(60))) for _ in range(30))]
    s, body = over(spark, bodies, analyzer=analyzer)
    expected = []
    for i, b in enumerate(bodies):
        words = (b or "").split()
        expected += [(t, i, words.count(t), [k for k, w in enumerate(words) if w == t], len(words)) for t in set(words)]
    assert sorted(tuple(x) for x in textindex.postings(s.df, body).collect()) == sorted(expected)


def test_terms_are_found_whole(spark):
    s, body = over(spark, ["with", "within", "forthwith, WITH! with", "w ith", "\U0001d400with", "ｗith it", None, "with\U0001f600with"])
    assert sorted(x.id for x in s.search(p.term(body, "with")).collect()) == [0, 2, 5, 7]
    assert dict(found(s.top_k(SearchRequest(r.text(body, "with"))))).keys() == {0, 2, 5, 7}
    assert sorted(x.id for x in s.search(p.any_terms(body, "it ith")).collect()) == [3, 5]
    assert sorted(x.id for x in s.search(p.all_terms(body, "forthwith with")).collect()) == [2]


def test_stable_texts_are_normalised():
    import regex
    import unicodedata

    from lexmill.functions.analysis import STABLE

    own = regex.compile(STABLE.replace(r"\z", r"\Z"))
    some = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and own.match(c)]
    assert len(some) > 20_000
    for c in some:
        assert unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) and unicodedata.normalize("NFKC", "e" + c) == "e" + c


def test_planning_modes_give_the_same(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 7, f"k{i % 40:02d}", "a b" if i % 3 else "b c") for i in range(400)] + [(900, None, None, None)], "id long, n int, name string, body string")
    plain = Searcher.over(df, SearchSchema.from_frame(df, "id", ("body",)))
    f, body = plain.schema.field, plain.schema.text_field("body")
    registry = indexes.IndexRegistry()
    for name, kind in (("n", IndexType.RANGE), ("name", IndexType.PREFIX), ("body", IndexType.TEXT)):
        d = indexes.IndexDefinition(f(name), kind)
        indexes.build(plain.df, d, str(tmp_path / name), f("id").column)
        registry.add(d, str(tmp_path / name))
    conditions = [p.eq(f("n"), 3), p.eq(f("n"), None), p.between(f("n"), 1, 5), p.between(f("n"), 5, 1), p.prefix(f("name"), "k1"), p.eq(f("name"), "k07"), p.term(body, "a"), p.any_terms(body, "a c"), p.all_terms(body, "b c"), p.and_(p.eq(f("n"), 3), p.prefix(f("name"), "k0"), p.term(body, "c")), p.or_(p.eq(f("n"), 3), p.term(body, "c")), p.not_(p.term(body, "a"))]
    for q in conditions:
        ids = [[x.id for x in Searcher(plain.df, plain.schema, registry, mode=m).search(q).collect()] for m in indexes.PlanningMode]
        assert ids[0] == ids[1] == ids[2] == [x.id for x in plain.search(q).collect()]
        e = plain.estimate(q) or Searcher(plain.df, plain.schema, registry).estimate(q)
        if e is not None and not isinstance(q, p.And):
            assert e.least <= len(ids[0]) <= e.most
    way = lambda q, m: indexes.access_path(q, registry, spark, m)
    assert way(p.eq(f("n"), 3), indexes.PlanningMode.COST_AWARE).estimate.exact and way(p.between(f("n"), 0, 5), indexes.PlanningMode.COST_AWARE) is None
    assert way(p.between(f("n"), 0, 5), indexes.PlanningMode.FORCE_INDEX).estimate.cardinality == sum(i % 7 <= 5 for i in range(400)) and way(p.eq(f("n"), 3), indexes.PlanningMode.FORCE_SCAN) is None
    assert way(p.and_(p.between(f("n"), 0, 5), p.eq(f("name"), "k07")), indexes.PlanningMode.COST_AWARE).name == "name:prefix"


def test_filter_leaves_statistics_alone(spark):
    s, body = over(spark, ["java", "java search", "engine"], ["x", "y", "x"])
    every = dict(found(s.top_k(SearchRequest(r.text(body, "java")))))
    only = found(s.top_k(SearchRequest(r.text(body, "java"), p.eq(s.schema.field("grp"), "y"))))
    assert only == [(1, every[1])]


def test_alternatives_and_gaps(spark):
    # "quick" and "fast" at one place; the next word two places behind
    words = {"quick": [Token("quick"), Token("fast", 0)], "gap": []}

    def run(text):
        out, extra = [], 0
        for w in text.split():
            if w == "gap":
                extra += 1
                continue
            out += [Token(t.term, t.increment + extra if i == 0 else 0) for i, t in enumerate(words.get(w, [Token(w)]))]
            extra = 0
        return out

    s, body = over(spark, ["fast fox", "quick gap fox", "slow fox", "fast gap fox"], analyzer=FunctionAnalyzer(run))
    assert sorted(i for i, _ in found(s.top_k(SearchRequest(r.phrase(body, "quick fox"))))) == [0]
    assert sorted(i for i, _ in found(s.top_k(SearchRequest(r.phrase(body, "quick gap fox"))))) == [1, 3]
    with pytest.raises(UnsupportedAnalyzer):
        s.highlight(HighlightedSearchRequest(SearchRequest(r.text(body, "fox")), (body,)))


def test_pages_walk_ties(spark):
    s, body = over(spark, ["java" if i % 2 else "java search" for i in range(23)])
    request = SearchPageRequest(SearchRequest(r.text(body, "java"), limit=5), totals=TotalHitsMode.EXACT)
    whole, page, seen = found(s.top_k(SearchRequest(request.search.query, limit=100))), s.page(request), []
    while True:
        seen += found(page.hits)
        assert page.total == 23
        if page.next is None:
            break
        page = s.page(request.next(page.next))
    assert seen == whole
    cursor = s.page(request).next
    reasons = SearchCursorError.Reason
    for searcher, req, after, reason in (
        (s, request, object(), reasons.UNSUPPORTED_CURSOR),
        (Searcher(s.df, s.schema, engine="other"), request, cursor, reasons.DIFFERENT_ENGINE),
        (s, SearchPageRequest(SearchRequest(request.search.query, limit=5)), cursor, reasons.DIFFERENT_REQUEST),
        (Searcher(s.df, s.schema, version=2), request, cursor, reasons.STALE_SNAPSHOT),
    ):
        with pytest.raises(SearchCursorError) as e:
            searcher.page(SearchPageRequest(req.search, after))
        assert e.value.reason is reason


def test_explain(spark):
    s, body = over(spark, ["java search", "engine"], ["x", "y"])
    request = SearchRequest(r.bool_().must(r.text(body, "java")).should(r.phrase(body, "java search")).build(), p.eq(s.schema.field("grp"), "x"))
    e = s.explain(request, 0)
    assert e.matched and e.score == found(s.top_k(request))[0][1] and len(e.children) == 2
    assert not s.explain(request, 1).matched and s.explain(request, 9) is None
    assert any("tf 1" in line for line in e.lines())


def test_highlight(spark):
    s, body = over(spark, ["the \U0001f600 Quick brown fox. A quick end", "none"])
    df = s.highlight(HighlightedSearchRequest(SearchRequest(r.text(body, "quick")), (body,), context=3, max_fragments=1))
    (h,) = df.collect()[0].highlights
    assert h.field == "body" and [(x.start, x.end, x.text) for x in h.fragments] == [(4, 15, "\U0001f600 Quick br")]
    assert [(x.start, x.end) for x in h.fragments[0].spans] == [(7, 12)]
    assert merged([(3, 5), (0, 2), (1, 3)]) == [(0, 3), (3, 5)]
    assert [f.text for f in fragments("abcdefgh", [(1, 2), (6, 7)], 1, 5)] == ["abc", "fgh"]


def test_failures(spark):
    s, body = over(spark, ["a"])
    for bad in (lambda: r.phrase(body, "a", -1), lambda: r.text(body, "a").boost(0), lambda: r.bool_().should(r.text(body, "a")).minimum_should_match(0).build(), lambda: r.bool_().should(r.text(body, "a")).minimum_should_match(2).build(), lambda: SearchRequest(r.text(body, "a"), limit=0), lambda: bm25.Bm25Config(-1), lambda: bm25.Bm25Config(b=2), lambda: s.top_k(SearchRequest(r.fuzzy(body, "two words"))), lambda: s.top_k(SearchRequest(r.text(TextField("body"), "a")))):
        with pytest.raises(InvalidArgument):
            bad()
    for bad in (lambda: r.bool_().build(), lambda: SearchRequest(), lambda: HighlightedSearchRequest(SearchRequest(r.text(body, "a")))):
        with pytest.raises(InvalidState):
            bad()
    strict = Searcher(s.df, s.schema, strict=True)
    with pytest.raises(InvalidState):
        strict.top_k(SearchRequest(r.text(body, "a")))
    assert found(strict.top_k(SearchRequest(r.text(body, "--")))) == []
    assert Field("x") != Field("x")
