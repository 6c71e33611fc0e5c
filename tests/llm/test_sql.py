"""Training-data queries that have SQL give the rows that DuckDB gives for it."""

import duckdb
import pytest

from skein.llm import queries as llm
from tests.test_oracle import TABLES, as_rows

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = llm.QUERIES[name](spark, DATA)
    cursor = c.execute(llm.SQL[name])
    columns = [x[0] for x in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert as_rows(got.columns, got.collect()) == as_rows(columns, cursor.fetchall())
