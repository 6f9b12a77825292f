"""Every registered query with check SQL agrees with DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from check import rows_of
from faultline.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_agrees(spark, con, key):
    df = QUERIES[key](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(ORACLES[key])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(columns, res.fetchall())


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
