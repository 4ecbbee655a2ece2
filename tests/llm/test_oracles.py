"""Queries with SQL equal it, and every query runs, on the small tables."""

import duckdb
import pytest

from factloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    got = [tuple(r[c] for c in order) for r in df.collect()]
    place = [want.columns.index(c) for c in order]
    assert sorted(got, key=repr) == sorted((tuple(r[i] for i in place) for r in want.fetchall()), key=repr)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 11)]
