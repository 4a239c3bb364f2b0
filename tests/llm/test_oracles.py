"""Corpus queries against their SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from sessionloom.llm.oracles import ORACLES
from sessionloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain(row):
    return tuple(None if v is None or v != v else round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    found = QUERIES[name](spark, DATA)
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    rows = sorted((plain(r[c] for c in columns) for r in found.collect()), key=repr)
    assert rows == sorted(map(plain, cursor.fetchall()), key=repr)


def test_every_query_is_known():
    assert set(ORACLES) <= set(QUERIES)
