"""Every query with SQL gives that SQL's rows."""

import os

import duckdb
import pytest

from celltrail.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(registry.SQL))
def test_query_gives_its_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    con = duckdb.connect()
    for table in os.listdir(SF):
        con.execute(f"create view {table.removesuffix('.parquet')} as select * from '{SF}/{table}'")
    cur = con.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    want = [tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(names) and sorted(got, key=str) == sorted(want, key=str) and got
