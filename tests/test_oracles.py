"""Every SQL-expressible registered query equals its DuckDB oracle (sf0.001)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from churnspark.oracles import ORACLES

SF = "/root/testdata/sf0.001"
TABLES = ["orders", "customer", "nation", "lineitem", "part"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{os.path.join(SF, t)}.parquet')")
    return c


def _norm(v, places=6):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, places) + 0.0)
    return repr(v)


def _rows(tbl, places):
    cols = sorted(tbl.column_names)
    data = [tbl.column(c).to_pylist() for c in cols]
    return cols, sorted(tuple(_norm(x[i], places) for x in data) for i in range(tbl.num_rows))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    st = E.queries()[name](spark, SF).toArrow()
    dt = con.sql(ORACLES[name]).arrow()
    dt = dt.read_all() if hasattr(dt, "read_all") else dt
    sc, sr = _rows(st, 6)
    dc, dr = _rows(dt, 6)
    assert sc == dc
    assert st.num_rows == dt.num_rows
    assert sr == dr
