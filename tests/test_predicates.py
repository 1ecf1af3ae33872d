import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.errors import InvalidArgument
from lexmill.operators.execute import Searcher
from lexmill.plans import predicates as p
from lexmill.schema import Field, SearchSchema, TextField

ROWS = [(1, None, None), (2, "", 0.0), (3, "abc", -0.0), (4, "abd", math.nan), (5, "ab", math.inf), (6, "b\U0001f600", 1.5), (7, "b￮", -math.inf)]


@pytest.fixture(scope="module")
def searcher(spark):
    df = spark.createDataFrame(ROWS, "id long, text string, score double")
    return Searcher.over(df, SearchSchema.from_frame(df, "id"))


def ids(df):
    return [r.id for r in df.select("id").collect()]


def test_nulls_and_signed_zeros(searcher):
    f = searcher.schema.field
    text, score = f("text"), f("score")
    assert ids(searcher.search(p.eq(text, None))) == [1]
    assert ids(searcher.search(p.not_(p.eq(text, "abc")))) == [1, 2, 4, 5, 6, 7]
    assert ids(searcher.search(p.eq(score, -0.0))) == [3]
    assert ids(searcher.search(p.eq(score, 0.0))) == [2]
    assert ids(searcher.search(p.eq(score, math.nan))) == [4]
    assert ids(searcher.search(p.between(score, 0.0, 9.0))) == [2, 6]
    assert ids(searcher.search(p.between(score, -1.0, -0.0))) == [3]
    assert ids(searcher.search(p.between(score, -math.inf, math.inf))) == [2, 3, 5, 6, 7]
    assert ids(searcher.search(p.between(score, math.nan, math.nan))) == [4]
    assert ids(searcher.search(p.between(score, 1.0, -1.0))) == []
    assert ids(searcher.search(p.prefix(text, ""))) == [2, 3, 4, 5, 6, 7]
    assert ids(searcher.search(p.prefix(text, "ab"))) == [3, 4, 5]
    assert ids(searcher.search(~p.prefix(text, "ab"))) == [1, 2, 6, 7]
    assert ids(searcher.search(p.and_())) == [1, 2, 3, 4, 5, 6, 7]
    assert ids(searcher.search(p.or_())) == []


def test_string_ranges_go_by_utf16(searcher):
    text = searcher.schema.field("text")
    # U+1F600 begins with the unit D83D, below U+FFEE
    assert ids(searcher.search(p.between(text, "b￮", "c"))) == [7]
    assert ids(searcher.search(p.between(text, "b", "b￭"))) == [6]


def test_arguments(searcher):
    f = searcher.schema.field
    with pytest.raises(InvalidArgument, match="did you mean 'score'"):
        f("scroe")
    with pytest.raises(InvalidArgument):
        p.between(f("score"), None, 1.0)
    with pytest.raises(InvalidArgument):
        p.prefix(f("score"), "a")
    with pytest.raises(InvalidArgument):
        searcher.search(p.eq(Field("text"), "abc"))
    with pytest.raises(InvalidArgument):
        p.term(TextField("text"), "two words")


def test_declared_order(spark):
    size = Field("size", order=("small", "medium", "large"))
    key = Field("id", T.LongType())
    s = Searcher.over(spark.createDataFrame([(1, "large"), (2, "medium"), (3, None), (4, "small")], "id long, size string"), SearchSchema(key, [size]))
    assert ids(s.search(p.between(size, "medium", "large"))) == [1, 2]


def test_random_trees_against_python(spark):
    rng = random.Random(42)
    rows = [(i, rng.choice([None, "a", "ab", "b", "ba"]), rng.choice([None, 1, 2, 3, 4])) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, s string, n int")
    schema = SearchSchema.from_frame(df, "id")
    s, n = schema.field("s"), schema.field("n")

    def tree(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind == 0:
            v = rng.choice([None, "a", "b"])
            return p.eq(s, v), lambda r: r[1] == v
        if kind == 1:
            lo, hi = rng.randrange(5), rng.randrange(5)
            return p.between(n, lo, hi), lambda r: r[2] is not None and lo <= r[2] <= hi
        if kind == 2:
            start = rng.choice(["", "a", "b"])
            return p.prefix(s, start), lambda r: r[1] is not None and r[1].startswith(start)
        if kind == 3:
            q, f = tree(depth - 1)
            return p.not_(q), lambda r: not f(r)
        parts = [tree(depth - 1) for _ in range(rng.randrange(3))]
        if kind == 4:
            return p.and_(*[q for q, _ in parts]), lambda r: all(f(r) for _, f in parts)
        return p.or_(*[q for q, _ in parts]), lambda r: any(f(r) for _, f in parts)

    cases = [tree(3) for _ in range(25)]
    flags = df.select("id", *[q.column().alias(f"q{i}") for i, (q, _) in enumerate(cases)]).orderBy("id").collect()
    for row, flag in zip(rows, flags, strict=True):
        assert [flag[f"q{i}"] for i in range(len(cases))] == [f(row) for _, f in cases]


def test_pushdown_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id as string) s", "cast(id as double) x").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    schema = SearchSchema.from_frame(df, "id")
    for q, expected in ((p.prefix(schema.field("s"), "12"), "StringStartsWith"), (p.between(schema.field("id"), 3, 9), "GreaterThanOrEqual"), (p.eq(schema.field("id"), 3), "EqualNullSafe")):
        plan = df.where(q.column()).select("id")._jdf.queryExecution().executedPlan().toString()
        assert expected in plan, plan
    assert df.where(p.match_all().column()).count() == df.where(F.lit(True)).count()
