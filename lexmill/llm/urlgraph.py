"""URL filters: rules by host and path, and link-graph propagation where no rule speaks.

Trust is personalised PageRank from the hosts whose pages rules allow, over host edges;
distrust is the same from the hosts whose pages rules block, over the edges reversed: who links
to what is blocked is distrusted. A seed weighs the share of its pages that the rules allow
(block). A host is blocked when its distrust exceeds its trust and reaches a threshold, in units of the
score that a seed of full weight has from itself.

Host edges are the absolute and scheme-relative links of the pages' html, counted, and an edge each way
between a host and the next longer domain that is a host too. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, small

#: Damping, and the distrust that blocks. Rounds go on until none adds more than TOLERANCE to a host's score, in the threshold's units.
DAMPING, THRESHOLD, TOLERANCE = 0.85, 0.5, 1e-4
#: Rounds between two cuts of the lineage.
STRIDE = 6
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""

#: (verdict, host, path)
Rule = tuple[str, str, str]


def parse_rule(text: str) -> Rule:
    """``allow com/`` or ``block example.com/en/``."""
    verdict, _, where = text.strip().partition(" ")
    host, slash, path = where.strip().partition("/")
    if verdict not in ("allow", "block") or not host or not slash:
        raise ValueError(f"no rule: {text!r}")
    return verdict, host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), slash + path


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """Behind the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. Longest is by host and path together; of two as
    long the one with the longer host, then the first given."""
    out: Column | None = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        one = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, one) if out is None else out.when(fits, one)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) from ``pages (host, html)``: links between different hosts, and hosts with their parent domains."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lower_ascii)).alias("dst"))
    links = links.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    hosts = pages.where("host <> ''").select("host").distinct()
    parts = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.struct(i.alias("level"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("dst")))
    chains = hosts.select(F.col("host").alias("src"), F.explode(F.when(F.size(parts) >= 2, above)).alias("a")).select("src", "a.level", "a.dst")
    parent = chains.join(hosts.withColumnRenamed("host", "dst"), "dst", "left_semi").groupBy("src").agg(F.min(F.struct("level", "dst"))["dst"].alias("dst"))
    both = parent.select("src", "dst").unionByName(parent.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return links.unionByName(both.withColumn("n", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from ``edges (src, dst, n)`` and ``seeds (host, trust, distrust)``,
    which holds every host: r = (1 - d) seed + d * (what flows in), summed step by step until a step adds to no host
    more than ``tolerance * (1 - d)``. Mass at hosts without out-edges is lost. Hosts that only links name get scores too."""
    flow = edges.select(F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n").unionByName(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n"))
    out = flow.groupBy("kind", "a").agg(F.sum("n").alias("all"))
    flow = cut(flow.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("all")).alias("share")))
    start = cut(seeds.select("host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("trust").alias("seed")), F.struct(F.lit(1).alias("kind"), F.col("distrust").alias("seed")))).alias("s")).select("s.kind", "host", "s.seed").where("seed > 0"))
    seed = (1 - damping) * F.col("seed")
    r = start.select("kind", "host", seed.alias("r"), seed.alias("step"))  # step: what the last round added
    spreads = not flow.isEmpty()
    while spreads:
        for _ in range(STRIDE):
            step = (damping * F.col("step") * F.col("share")).alias("step")
            moved = r.join(flow.withColumnRenamed("a", "host"), ["kind", "host"]).select("kind", F.col("b").alias("host"), step).withColumn("r", F.col("step"))
            r = r.withColumn("step", F.lit(0.0)).unionByName(moved).groupBy("kind", "host").agg(F.sum("r").alias("r"), F.sum("step").alias("step"))
        r = cut(r)
        if (r.agg(F.max("step")).first()[0] or 0.0) <= tolerance * (1 - damping):
            break
    return r.groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("r"))), F.lit(0.0)).alias("trust"), F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("r"))), F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: list[Rule], threshold: float = THRESHOLD, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """One row per row of ``pages (page_id, url, html, ...)``: page_id, host, path, rule, verdict,
    trust and distrust. verdict is the rule's where one fits; else ``block`` where the host's distrust is above
    its trust and at least ``threshold * (1 - damping)``, else ``allow``.

    Null url, or one without ``://``: host and path empty, no rule, allow. Null html: no links. Repeated rows
    have equal results and count as pages. An empty table gives no rows. Further columns are ignored.
    """
    parsed = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    parsed = parsed.withColumn("hit", matched(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.coalesce(F.col("hit.verdict") == verdict, F.lit(False)).cast("double"))
    seeds = parsed.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = cut(propagate(host_edges(parsed.select("host", "html")), seeds, tolerance, damping).withColumnRenamed("host", "_host"))
    out = parsed.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("ruled")).join(small(scores), F.col("host") == F.col("_host"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    bad = (distrust > trust) & (distrust >= threshold * (1 - damping))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
