"""Secret scans with multipart credential linking, in built-in functions only.

Three base patterns are strong enough to be reported alone. Weak parts are not: an access
identifier (``client_id = ...``, ``user: ...``), a secret (a short assignment, or a token of
mixed letters and digits) or an endpoint (a URL, ``host: ...``). A weak part is reported only
when its complement reaches into its scope, ``SCOPE`` code points around it: for a secret an identifier or an endpoint,
for these a secret. Base findings count as parts too. That is an interval join of the parts of a text with each other,
done as an equality join on the scope-sized cells that a part and a scope cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, small

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Base kinds in their listed order, with role.
BASE = ("assign", "access", "hex")
#: Weak kinds: pattern, and what a text must contain to be looked at.
WEAK = {
    "client": (r"""(?i:client_id|access_id|account_id|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", r"(?i)(?:_id|user|username|login)[\"']?\x20*[:=]"),
    "phrase": (r"""(?i:password|passwd|secret|token|api_?key|pwd|pass)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(?i)(?:passw|secret|token|key|pwd|pass)[a-z\"']*\x20*[:=]"),
    "opaque": (r"[A-Za-z0-9+/_=-]{24,}", r"[A-Za-z0-9+/_=-]{24,}"),
    "endpoint": (r"""[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:-]{3,}""", r"://|(?i)(?:host|endpoint|server)[\"']?\x20*[:=]"),
}


def weak_enough(kind: str):
    """What a weak kind's match must be, besides matching: a phrase's value of 4 to 7 characters; letters and digits in an opaque token."""
    if kind == "phrase":
        return lambda hit: F.length(F.regexp_extract(hit, WEAK["phrase"][0], 1)).between(4, 7)
    if kind == "opaque":
        return lambda hit: hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    return None


#: What each kind is part of: an identifier, a secret or an endpoint.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "client": "id", "phrase": "secret", "opaque": "secret", "endpoint": "endpoint"}
KINDS = (*BASE, *WEAK)
#: Matches whose places are summed up together: the cost of many matches in a text grows with their number times this.
CHUNK = 64
#: Code points before or behind a part that its complement must reach into.
SCOPE = 200
SPAN = "array<struct<begin:int,finish:int,kind:int>>"


def none() -> Column:
    return F.array().cast(SPAN)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Leftmost matches that do not overlap, as (begin, finish, kind) in code points: what stands
    between the matches, and the matches, give their places by their lengths."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("hit")))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["gap"]
        finish = begin + s["len"]
        one = F.array(F.struct(begin.alias("begin"), finish.alias("finish"), F.lit(kind).alias("kind")))
        found = F.concat(acc["out"], one if keep is None else F.when(keep(s["hit"]), one).otherwise(none()))
        return F.struct(finish.alias("at"), found.alias("out"))

    def placed(some: Column, start: Column) -> Column:
        return F.aggregate(some, F.struct(start.alias("at"), none().alias("out")), step, lambda acc: acc["out"])

    def chunked(every: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(every) / CHUNK).cast("int") - 1), lambda k: F.slice(every, k * CHUNK + 1, F.lit(CHUNK)))
        begun = lambda parts: F.aggregate(parts, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(c, F.lit(0), lambda n, s: n + s["gap"] + s["len"]))))
        return _let(chunks, lambda parts: F.flatten(F.zip_with(parts, F.slice(begun(parts), F.lit(1), F.size(parts)), placed)))

    return _let(steps, lambda every: F.when(F.size(every) > CHUNK, chunked(every)).otherwise(placed(every, F.lit(0))))


def base_spans(text: Column) -> Column:
    """Spans of the three base patterns, by begin and then kind as listed."""
    long_value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8
    assign = F.when(text.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), _spans(text, ASSIGN, 0, long_value)).otherwise(none())
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, 1)).otherwise(none())
    hexes = F.when(text.rlike(HEX), _spans(text, HEX, 2)).otherwise(none())
    return F.when(text.isNull(), none()).otherwise(_ordered(F.concat(assign, access, hexes)))


def weak_spans(text: Column) -> Column:
    found = [F.when(text.rlike(test), _spans(text, pattern, KINDS.index(kind), weak_enough(kind))).otherwise(none()) for kind, (pattern, test) in WEAK.items()]
    return F.when(text.isNull(), none()).otherwise(F.concat(*found))


def _ordered(spans: Column) -> Column:
    """By begin, then kind as listed, then finish (the struct's own order is begin, finish, kind)."""
    turned = F.transform(spans, lambda s: F.struct(s["begin"].alias("begin"), s["kind"].alias("kind"), s["finish"].alias("finish")))
    return F.transform(F.array_sort(turned), lambda s: F.struct(s["begin"].alias("begin"), s["finish"].alias("finish"), s["kind"].alias("kind")))


def digest(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["begin"].cast("string"), s["finish"].cast("string"))))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs (doc_id, text, ...)``: doc_id, tie (a hash of the text), base and
    spans, arrays of (begin, finish, kind) in code points, end exclusive; kind indexes ``KINDS``.
    base has the base patterns' findings; spans has these and the linked weak parts. A weak part that
    overlaps a base finding adds nothing and isn't reported.

    Null or empty text: no spans. Repeated rows: each has the same result. Null ids are kept and
    told apart by their text. An empty table gives no rows. Further columns are ignored.
    """
    text = F.col("text")
    found = cut(docs.select("doc_id", F.xxhash64("text").alias("tie"), F.sha1("text").alias("whole"), base_spans(text).alias("base"), weak_spans(text).alias("weak")))
    weak = found.where("size(weak) > 0").select("doc_id", "whole", "base", "weak").distinct()
    roles = F.array(*[F.lit(ROLE[k]) for k in KINDS])
    part = lambda column: weak.select("doc_id", "whole", F.explode(column).alias("s")).select("doc_id", "whole", "s", F.element_at(roles, F.col("s.kind") + 1).alias("role"))
    free = F.filter("weak", lambda w: ~F.exists("base", lambda b: (w["begin"] < b["finish"]) & (b["begin"] < w["finish"])))
    left = part(free).withColumn("cell", F.explode(F.sequence(F.floor((F.col("s.begin") - scope) / scope), F.floor((F.col("s.finish") + scope) / scope))))
    right = part(F.concat("base", "weak")).select(F.col("doc_id").alias("_id"), F.col("whole").alias("_whole"), F.col("s.begin").alias("_begin"), F.col("s.finish").alias("_finish"), F.col("role").alias("_role"), F.explode(F.sequence(F.floor(F.col("s.begin") / scope), F.floor(F.col("s.finish") / scope))).alias("_cell"))
    near = (F.col("_finish") >= F.col("s.begin") - scope) & (F.col("_begin") <= F.col("s.finish") + scope)
    linked = left.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("whole") == F.col("_whole")) & (F.col("cell") == F.col("_cell")) & near & ((F.col("role") == "secret") != (F.col("_role") == "secret")), "left_semi")
    linked = linked.groupBy("doc_id", "whole").agg(F.collect_set("s").alias("linked")).withColumnsRenamed({"doc_id": "_id", "whole": "_whole"})
    out = found.join(linked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("whole") == F.col("_whole")), "left")
    return out.select("doc_id", "tie", "base", _ordered(F.concat("base", F.coalesce("linked", none()))).alias("spans"))


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``<kind>``; spans that overlap
    become one, named after the first. Other columns stay, whatever their names, but n_chars follows the text where it is there."""
    spans = scan(docs, scope).where("size(spans) > 0").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("spans").alias("_spans")).distinct()
    text = F.col("_row").getField("text")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        new = s["begin"] >= acc["at"]
        more = F.when(new, F.concat(F.substring(text, acc["at"] + 1, s["begin"] - acc["at"]), F.element_at(names, s["kind"] + 1))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["finish"]).alias("at"), F.concat(acc["text"], more).alias("text"))

    clean = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("text")), step, lambda acc: F.concat(acc["text"], F.substring(text, acc["at"] + 1, F.length(text))))
    held = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_key"), F.xxhash64("text").alias("_hash"))
    out = held.join(small(cut(spans, docs.count())), F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_tie")), "left")
    out = out.select("_row", "_spans", F.when(F.col("_spans").isNull(), text).otherwise(clean).alias("_clean"))
    own = {c: F.col("_row").getField(c) for c in docs.columns}
    own |= {"text": F.col("_clean")} | ({"n_chars": F.coalesce(F.when(F.col("_spans").isNotNull(), F.length("_clean").cast("long")), own["n_chars"])} if "n_chars" in own else {})
    return out.select(*[c.alias(name) for name, c in own.items()])
