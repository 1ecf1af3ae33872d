import pytest

from lexmill.llm import urlgraph
from lexmill.llm.queries import RULES

RULE = [urlgraph.parse_rule(r) for r in RULES]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, trust string")


URLS = ["http://www.Example.COM/en/1?x#y", "https://example.com/en/", "http://a.com", "http://a.com?q=/", "http://b.net/es/x", "ftp://com/", "http://notcom/", "no scheme", None, "", "x://y://z/", "http://a.net/en\n/fr/", "HTTP://U@A.Net:80/fr/#", "://", "http://deep.example.com/en/q"]


def test_hosts_paths_and_rules(spark):
    got = urlgraph.judge(pages(spark, [(u, None) for u in URLS]), RULE).collect()
    for r in got:
        u = URLS[r.page_id] or ""
        host = path = ""
        if "://" in u:
            rest = u.split("://", 1)[1]
            end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
            host, tail = rest[:end].lower(), rest[end:]
            path = tail[: min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
        fits = [(len(h + p), h + p, v) for v, h, p in RULE if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert r.verdict == (max(fits)[2] if fits else "allow")
    assert got[0].rule == "www.example.com/en/" and got[14].rule == "example.com/en/"
    with pytest.raises(ValueError):
        urlgraph.parse_rule("maybe com/")


def ranks(edges, seeds, rounds, damping):
    out = {}
    for s, _, n in edges:
        out[s] = out.get(s, 0) + n
    r = {h: (1 - damping) * x for h, x in seeds.items()}
    base = dict(r)
    for _ in range(rounds):
        new = dict(base)
        for s, d, n in edges:
            new[d] = new.get(d, 0) + damping * r.get(s, 0) * n / out[s]
        r = new
    return r


def test_propagation_against_python(spark):
    edges = [("a", "b", 2.0), ("a", "c", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("d", "c", 3.0), ("e", "d", 1.0)]
    seeds = [("a", 1.0, 0.0), ("b", 0.0, 0.0), ("c", 0.0, 0.5), ("d", 0.0, 0.0), ("e", 0.25, 0.0)]
    df = urlgraph.propagate(spark.createDataFrame(edges, "src string, dst string, n double"), spark.createDataFrame(seeds, "host string, trust double, distrust double"), 1e-12)
    trust = ranks(edges, {h: t for h, t, _ in seeds}, 300, 0.85)
    distrust = ranks([(d, s, n) for s, d, n in edges], {h: x for h, _, x in seeds}, 300, 0.85)
    for r in df.collect():
        assert r.trust == pytest.approx(trust.get(r.host, 0)) and r.distrust == pytest.approx(distrust.get(r.host, 0))


def test_who_links_to_blocked_hosts_is_blocked(spark):
    rules = [urlgraph.parse_rule(r) for r in ("block bad.example/", "allow good.example/")]
    link = lambda *hosts: "".join(f"<a href='http://{h}/x'>x</a>" for h in hosts)
    rows = [("http://bad.example/1", ""), ("http://good.example/1", link("fine.test")), ("http://farm.test/1", link("bad.example") * 20), ("http://fine.test/2", '<img SRC=//other.test/p>'), ("http://sub.fine.test/", None)] * 3
    verdicts = {r.host: r.verdict for r in urlgraph.judge(pages(spark, rows), rules).collect()}
    assert verdicts == {"bad.example": "block", "good.example": "allow", "farm.test": "block", "fine.test": "allow", "sub.fine.test": "allow"}
    edges = {(r.src, r.dst): r.n for r in urlgraph.host_edges(urlgraph.judge(pages(spark, rows), rules).select("host").withColumn("html", __import__("pyspark").sql.functions.lit(None).cast("string"))).collect()}
    assert edges == {("sub.fine.test", "fine.test"): 1.0, ("fine.test", "sub.fine.test"): 1.0}
    assert urlgraph.judge(pages(spark, []), rules).count() == 0
