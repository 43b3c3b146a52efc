"""Training-data queries that SQL can express, against DuckDB at the smallest scale."""

from collections import Counter

import duckdb
import pytest

from ledgerlink.llm.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, key):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = QUERIES[key](spark, DIR)
    want = con.sql(SQL[key])
    names = sorted(df.columns)
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert Counter(tuple(r[n] for n in names) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in want.fetchall())
