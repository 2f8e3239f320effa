"""Every registered query of the library against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tallygrove.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v) if isinstance(v, bool) or not isinstance(v, (int, float)) and not hasattr(v, "as_tuple") else f"{float(v):.9g}"


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    relation = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(relation.columns)
    columns = sorted(df.columns)
    at = [relation.columns.index(c) for c in columns]
    assert sorted("|".join(map(plain, r)) for r in df.select(*columns).collect()) == sorted("|".join(plain(r[i]) for i in at) for r in relation.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
