"""Every query of the reports against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from sessionlore.plans.registry import ORACLE, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    if name not in ORACLE:
        return
    result = db.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert sorted(names) == columns
    key = lambda r: [(x is None, str(x)) for x in r]
    assert sorted(got, key=key) == sorted(want, key=key)
