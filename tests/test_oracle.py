"""Every query beside its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return None if v is None else str(v)


def test_every_sql_names_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=lambda r: tuple("\0" if v is None else v for v in r))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert cols
        return
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = sorted((tuple(norm(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=lambda r: tuple("\0" if v is None else v for v in r))
    assert sorted(names) == cols
    assert rows == want
