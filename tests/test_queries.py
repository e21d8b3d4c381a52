"""Every query with SQL gives that SQL's rows; views are the same text, metrics are written twice."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from callscope.plans.all import ORACLES, QUERIES
from callscope.plans.views import TABLES


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(df):
    rows = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        rows.append(tuple("-" if pd.isna(v) else round(float(v), 5) if isinstance(v, (float, int, np.number)) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(rows, key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, data, duck, name):
    ours, theirs = QUERIES[name](spark, data).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
