"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quarry.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(DATA):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return c


def rows(frame):
    def plain(v):
        if hasattr(v, "item"):
            v = v.item()
        if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        return round(float(v), 5) if isinstance(v, int | float) and not isinstance(v, bool) else v

    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(map(plain, r))) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(duck.execute(ORACLES[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
