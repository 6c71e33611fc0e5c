"""Every query that has SQL gives the rows that DuckDB gives for it."""

import math
from decimal import Decimal

import duckdb
import pytest

from skein import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (float, Decimal)):
        return "nan" if math.isnan(x) else round(float(x), 5) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return str(x) if x is not None else None


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_matches_sql(spark, duck, name):
    got = core.QUERIES[name](spark, DATA)
    cursor = duck.execute(core.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert as_rows(got.columns, got.collect()) == as_rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs(spark, name):
    assert core.QUERIES[name](spark, DATA).collect() is not None
