"""Every query against DuckDB on the same files."""

import glob
import math
import os

import duckdb
import pytest

from millrace.plans import catalogue
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(v, 9) if isinstance(v, float) else str(v) if isinstance(v, list | dict) else v


def rows_of(names, rows):
    return sorted((tuple(plain(r[n]) for n in names) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SMALL)
    names = sorted(df.columns)
    mine = rows_of(names, [r.asDict() for r in df.collect()])
    sql = catalogue.oracle_sql().get(name)
    if sql is None:  # restated in tests/test_restated.py
        assert mine
        return
    got = duck.execute(sql)
    cols = [c[0] for c in got.description]
    assert sorted(cols) == names
    assert mine == rows_of(names, [dict(zip(cols, r, strict=True)) for r in got.fetchall()])
