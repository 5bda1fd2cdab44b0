"""Every library query with SQL gives DuckDB's rows over the same tables."""

import datetime
import math
from collections import Counter

import duckdb
import pytest

from tallyhouse.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)[:10] if str(value)[10:].strip(" 0:") == "" else str(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "None" if math.isnan(value) else f"{value:.6g}"
    return str(value)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    ours = registry.queries()[name](spark, SF)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert rows(ours.columns, [tuple(r) for r in ours.collect()]) == rows(names, cursor.fetchall())
