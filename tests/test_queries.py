"""Every query of the greenery operators against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from verdantspark.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, int | float) and not isinstance(v, bool):
        return round(float(v), 5)
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rows = got.collect()
    if name not in ORACLES:
        assert got.columns and len(rows) > 0
        return
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: repr(r)
    assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in rows), key=key) == sorted((tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in want.fetchall()), key=key)
