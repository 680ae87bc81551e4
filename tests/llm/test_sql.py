"""op queries against their SQL in DuckDB."""

import duckdb
import pytest

from loomlog.llm import queries

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    got = sorted(repr(tuple(r[c] for c in names)) for r in queries.queries()[name](spark, DIR).collect())
    assert got == want
