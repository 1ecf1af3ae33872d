"""Each query equals its DuckDB SQL on the smallest tables."""

import os

import duckdb
import pytest

from lexmill import lifecycle_queries  # noqa: F401  adds its queries to the others
from lexmill import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 5) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query(spark, con, name):
    df = core.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name in core.SQL:
        cursor = con.execute(core.SQL[name])
        expected, columns = cursor.fetchall(), [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert normal(rows, df.columns) == normal(expected, columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def zeros(spark, folder, name):
    """A query and its SQL, as text, which tells -0.0 from 0.0, over customers with both zeros."""
    balances = {1: -0.0, 2: 0.0, 3: 5.5, 4: -0.01, 5: -100.0, 7: -0.0, 10: -1.0, 11: -0.0, 50: -0.0, 51: None, 52: 3000.0, 53: 5000.0, 54: -0.0}
    rows = [(k, f"Customer#{k}", b) for k, b in balances.items()]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_acctbal double").write.parquet(f"{folder}/customer.parquet")
    df = core.QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{folder}/customer.parquet/*.parquet'")
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({core.SQL[name]})").fetchall()
    assert "-0.0" in str(expected)
    return sorted(str(tuple(r)) for r in df.collect()), sorted(map(str, expected))


def test_zeros_of_durable_changes(spark, tmp_path):
    got, expected = zeros(spark, tmp_path, "durable_changes")
    assert got == expected


def test_zeros_of_index_build_beside_writes(spark, tmp_path):
    got, expected = zeros(spark, tmp_path, "index_build_beside_writes")
    assert got == expected


def test_sql_round(spark):
    values = [None, -0.0, 0.0, 0.00005, -0.00005, -0.00001, 2.5, -999.99, 1e305, float("inf"), float("-inf"), float("nan"), *[(k * 13 - 4000) / 1e5 for k in range(2000)]]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    got = {r.id: str(r.v) for r in df.select("id", core.sql_round("v", 4)).collect()}
    con = duckdb.connect()
    assert got == {i: str(con.execute("SELECT round(?::DOUBLE, 4)", [v]).fetchone()[0]) for i, v in enumerate(values)}
    assert got != {r.id: str(r.v) for r in df.select("id", core.F.round("v", 4).alias("v")).collect()}
