"""Every query with SQL gives the SQL's rows on the smallest tables; all others run."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from millrace.plans.queries import QUERIES, SQL

duckdb = pytest.importorskip("duckdb")


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "%.7g" % value if math.isfinite(value) else str(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return str(value)


@pytest.fixture(scope="module")
def connection(data):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in os.listdir(data):
        table = name.split(".")[0]
        con.execute(f"create view {table} as select * from read_parquet('{data}/{table}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, connection, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name in SQL:
        result = connection.execute(SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        assert rows == Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())


def test_entry(spark):
    assert "slice0_quality_by_language" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
