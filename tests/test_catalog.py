"""Every catalogue query against its SQL in DuckDB."""

import math
import os

import pytest

from loomlog import catalog

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    want = sorted([repr([_plain(r[i]) for i in order]) for r in cur.fetchall()])
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    assert cols == sorted(names)
    got = sorted([repr([_plain(r[c]) for c in cols]) for r in df.collect()])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, DIR).count() > 0
