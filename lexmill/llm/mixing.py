"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key with its quality weight as rate, ``-ln(u) / w`` for
a uniform ``u`` hashed from its id. A source takes all its documents once for each complete
epoch its target holds; the fraction that is left goes to the documents with the smallest
keys, by a prefix sum of their sizes.

Built-in functions only. The prefix sum of a source isn't one task: keys are first cut into
ranges, whose sums are few rows, and each range then sums its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, small

#: Rows of a key range, about.
RANGE_ROWS = 4_000
WORD = r"[^\x20\x09-\x0D]+"


def uniform(seed: str, *columns: str) -> Column:
    """A number in (0, 1) from the first 48 bits of the md5 of seed and columns; null counts as the word null."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: str = "text") -> Column:
    """A weight in [0.05, 1.05]: the share of the text that isn't symbols, a cheap sign of prose."""
    symbols = F.length(F.translate(F.col(text), "#$%&*|<>{}[]~^=+\\@_0123456789!", ""))
    return F.coalesce(symbols / F.nullif(F.length(text), F.lit(0)), F.lit(0.0)).cast("double") + 0.05


def targets(sizes: DataFrame, weights: list[float], total: float | None = None, most: int = 3) -> DataFrame:
    """From ``sizes (source, source_size)``, one row per source, add ``target``.

    Sources by code point, null last, take the weights in turn. Targets share ``total`` (the
    sum of all sizes unless given) by weight; none is above ``most`` times its source's size,
    and what that leaves over is shared again by weight. Solved at once: by rising
    ``size / weight``, sources are capped as long as the share of the others would still be above.
    These are windows over one row per source.
    """
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1, F.lit(len(weights))) + 1).cast("int")))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * F.lit(float(most))
    ranked = ranked.withColumn("cap", cap).withColumn("all_weight", F.sum("weight").over(whole)).withColumn("all_size", F.lit(total) if total is not None else F.sum("source_size").over(whole).cast("double"))
    rest = (F.col("all_size") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", rest).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.max(F.when(F.col("free"), F.col("level"))).over(whole)  # the first free one's: behind it levels only fall
    return ranked.withColumn("share", level * F.col("weight")).select("source", "source_size", F.when(F.col("share") < F.col("cap"), F.col("share")).otherwise(F.col("cap")).alias("target"))


def plan(docs: DataFrame, weights: list[float], seed: str = "mix", most: int = 3, total: float | None = None, size: Column | None = None, quality: Column | None = None, range_rows: int = RANGE_ROWS, split_last: bool = False) -> DataFrame:
    """One row per row of ``docs (doc_id, text, source, ...)``: doc_id, source, tie (a hash of the
    text), size, source_size, target, copies and taken (words: copies * size).

    copies is the number of complete epochs of the source, and one more for the documents that
    the fraction selects: those by rising key for which at least half of the document lies before
    the budget's end. So a source takes its target but for half a document at most. With
    ``split_last`` the document at the budget's end is taken up to there, so that a source takes its
    target but for part of a word: taken then counts those words, and copies the copies begun.

    Null text: size 0. Null source: a source of its own, last. Documents of size 0 are taken once.
    A source whose documents are all empty has target 0. Repeated rows have equal keys and follow
    one another; documents equal in key, id and size follow by a hash of their text. Null ids are
    hashed as the word null. An empty table gives no rows.
    """
    facts = docs.select("doc_id", "source", F.xxhash64("text").alias("tie"), (size if size is not None else size_of()).alias("size"), (quality if quality is not None else quality_of()).alias("quality"))
    facts = cut(facts.withColumn("key", -F.log(uniform(seed, "doc_id")) / F.col("quality")))
    n = facts.count()
    sizes = cut(facts.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"), F.avg("quality").alias("rate")), n)
    goal = targets(sizes.select("source", "source_size"), weights, total, most).select(F.col("source").alias("_goal"), "target")
    named = cut(sizes.join(goal, F.col("source").eqNullSafe(F.col("_goal"))).drop("_goal").withColumnRenamed("source", "_source"), n)
    # Ranges of the key: 1 - exp(-key * mean rate) spreads exponential keys evenly over (0, 1), in their order.
    keyed = facts.join(small(named), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranges = F.ceil(F.col("rows") / range_rows)
    keyed = keyed.withColumn("range", F.least(F.floor((1 - F.exp(-F.col("key") * F.col("rate"))) * ranges), ranges - 1))
    sums = cut(keyed.groupBy("source", "range").agg(F.sum("size").alias("in_range")), n)
    start = sums.withColumn("start", F.sum("in_range").over(Window.partitionBy("source").orderBy("range")) - F.col("in_range")).select(F.col("source").alias("_source"), F.col("range").alias("_range"), "start")
    joined = keyed.join(small(start), F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range"))).drop("_source", "_range")
    inner = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    out = joined.withColumn("upto", F.col("start") + F.sum("size").over(inner))
    out = out.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    more = (rest > 0) & (F.col("upto") - F.col("size") / 2.0 <= rest)
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(rest) - F.col("upto") + F.col("size"))) if split_last else more.cast("long") * F.col("size")
    part = F.when(F.col("epochs") < most, part).otherwise(0)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("epochs") + (part > 0).cast("int"))
    return out.select("doc_id", "source", "tie", "size", "source_size", "target", copies.cast("long").alias("copies"), (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: list[float], **options) -> DataFrame:
    """The mixed corpus: each row of ``docs``, whole, as often as ``plan`` (same options) says, with the
    columns of ``docs``, whatever their names. Repeated rows all follow the largest number of copies among them."""
    picked = plan(docs, weights, **options).groupBy("doc_id", "source", "tie").agg(F.max("copies").alias("_copies"))
    picked = picked.where("_copies > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("tie").alias("_tie"), "_copies")
    same = F.col("_key").eqNullSafe(F.col("_id")) & F.col("_from").eqNullSafe(F.col("_source")) & (F.col("_hash") == F.col("_tie"))
    held = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_key"), F.col("source").alias("_from"), F.xxhash64("text").alias("_hash"))
    return held.join(small(cut(picked, docs.count())), same).select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
