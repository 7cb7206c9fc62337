"""Every registered query with SQL gives the rows DuckDB gives, on the smallest tables."""

import math

import duckdb
import pytest

from pointflux import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    result = duck.execute(plans.ORACLE_SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(plain(dict(zip(columns, row))[c]) for c in df.columns) for row in result.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in row) for row in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0
