"""Every query against its SQL at the smallest scale; none that is registered may be vacuous but those that this scale has no rows for."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from skerry.oracle.sql import ORACLE_SQL
from skerry.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
#: No row at this scale.
EMPTY = {"secret_scan", "contains_secret", "pending_status"}
#: Greedy, in an order of its own; test_units has its cases.
NO_SQL = {"query_chooser"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).iterdir():
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return (0, str(x))
    return (1, "nan" if math.isnan(x) else f"{round(float(x), 5) + 0.0:.5f}")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert name in NO_SQL and rows
        return
    got = con.sql(ORACLE_SQL[name])
    order = sorted(df.columns)
    assert order == sorted(got.columns)
    where = [got.columns.index(c) for c in order]
    want = sorted(tuple(plain(r[i]) for i in where) for r in got.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == want
    assert rows or name in EMPTY
