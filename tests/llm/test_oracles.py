"""The corpus queries that have SQL, against DuckDB."""

import os

import duckdb
import pytest

from verdantspark.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.execute(oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.fetchall())
