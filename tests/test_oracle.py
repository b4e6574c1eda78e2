"""Every registered query with SQL gives the SQL's rows, over whole tables."""

import glob
import os

import duckdb
import pytest

from quarry import plans

DATA = "/root/testdata/sf0.01"


def norm(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return str({k: norm(x) for k, x in v.items()})
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_sql(spark, con, name):
    df = plans.queries()[name](spark, DATA)
    cur = con.execute(plans.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in sorted(cols)]
    assert sorted(repr([norm(r[c]) for c in sorted(cols)]) for r in df.collect()) == sorted(repr([norm(r[i]) for i in order]) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
