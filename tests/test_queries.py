"""Every query with SQL against DuckDB, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

from tessera import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return x

    return sorted(([cell(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(oracles.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.SQL)))
def test_others_give_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_sparse_vectors_of_fixed_values(spark):
    """Indices of terms are fixed values; arrays are in the order of the terms."""
    from tessera.operators import sparse

    texts = spark.createDataFrame([(1, "world, hello world"), (2, "Hello"), (3, "!")], "id int, text string")
    rows = {r["id"]: (r["indices"], r["values"]) for r in sparse.sparse_vectors(sparse.term_frequencies(texts, ["id"]), ["id"]).collect()}
    assert rows == {1: ([1785136887, 13193140], [1.0, 2.0]), 2: ([1785136887], [1.0])}


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries.get_chunks(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "role" not in plan.split("ReadSchema")[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
