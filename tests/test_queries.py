"""Every registered query of the library runs, and equals its DuckDB SQL."""

import duckdb
import pytest

from factloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    got = comparable([tuple(r) for r in df.collect()], df.columns)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert got == comparable(want.fetchall(), want.columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(queries.queries()) <= set(e.queries()) and set(queries.oracle_sql()) <= set(e.oracle_sql())
