import random

import pytest
from pyspark.sql import types as T

#: Columns that an operator's own names could clash with.
EXTRA = ["size", "score", "kept", "component", "id", "u", "v", "rep", "bucket", "copies", "target", "tie", "base", "spans", "block", "n"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in EXTRA]])


def frame(spark, rows):
    """Documents from (doc_id, text[, lang, source]) with extra columns whose names clash."""
    full = []
    for r in rows:
        r = (*r, *[None] * (4 - len(r)))
        full.append((*r, len(r[1]) if r[1] is not None else None, *["x"] * len(EXTRA)))
    return spark.createDataFrame(full, SCHEMA)


def sentence(rng, n, vocabulary=400, letters="abcdefgh"):
    return " ".join("".join(letters[(i // 8**k) % 8] for k in range(3)) for i in (rng.randrange(vocabulary) for _ in range(n)))


@pytest.fixture
def rng():
    return random.Random(7)


def corpus(rng):
    """Documents with copies, near copies, shared passages, nulls, empty and very long texts, ties and repeated rows."""
    rows = [(i, sentence(rng, rng.randrange(5, 120))) for i in range(40)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # copies
    base = sentence(rng, 100).split()
    for i in range(12):  # near copies
        w = list(base)
        w[rng.randrange(100)] = "changed"
        rows.append((200 + i, " ".join(w)))
    passage = sentence(rng, 30)
    rows += [(300 + i, f"{sentence(rng, 10)}\n{passage}\t{sentence(rng, 10)}") for i in range(6)]
    rows += [(400, "a b " * 3000), (401, sentence(rng, 6000)), (402, "One TWO three"), (403, "one two THREE"), (404, "")]
    rows += [(405, None), (406, " \n\t"), (None, rows[0][1]), (None, None), rows[3], rows[3], (407, rows[2][1] + "  "), (-5, "x\x1cy z\x85 é\xa0ü")]
    return rows
