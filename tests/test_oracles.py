"""Every query with SQL against DuckDB on the smallest tables, and a schema for every other one."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from strandloom.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


#: Queries whose result is empty on the smallest tables.
EMPTY = {"range_join"}


def rows(frame):
    cell = lambda v: "null" if pd.api.types.is_scalar(v) and pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, sf, name):
    ours, theirs = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
    assert len(ours) or name in EMPTY


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
