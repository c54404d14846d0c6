"""Every registered query of the bank tables against its SQL in DuckDB."""

import datetime
import math

import duckdb
import pytest

from tallyforge.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)):
        return None if math.isnan(value) else float(f"{float(value):.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value if value is None or isinstance(value, (str, datetime.date)) else float(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = catalogue.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in result.fetchall())
    assert sorted(repr(tuple(plain(row[c]) for c in columns)) for row in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_queries_without_sql_give_rows(spark, sf_dir, name):
    assert catalogue.queries()[name](spark, sf_dir).count() > 0
