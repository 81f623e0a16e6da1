"""Every registered query of the reference's kind against its SQL."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from rollcall.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return str([plain(x) for x in v])
    if pd.isna(v):
        return None
    return str(v) if isinstance(v, str) or hasattr(v, "isoformat") else float(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", ORACLES)
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
