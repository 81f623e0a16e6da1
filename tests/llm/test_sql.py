"""The queries of this subpackage that SQL can express, against it."""

import duckdb
import pytest

from rollcall.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = QUERIES[name](spark, DATA)
    want = c.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
