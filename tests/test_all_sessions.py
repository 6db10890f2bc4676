"""The parts of every session."""

import os

import duckdb
import pytest

from sessionlore.plans.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KEYS = {
    "tools": "SELECT user_id FROM events WHERE user_id IN (SELECT o_orderkey FROM orders)",
    "models": "SELECT l_orderkey FROM lineitem",
    "files": "SELECT l_orderkey FROM lineitem",
    "stop_reasons": "SELECT o_orderkey FROM orders",
    "pull_requests": "SELECT l_orderkey FROM lineitem",
    "attachments": "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'",
    "permission_changes": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'",
    "turns": "SELECT user_id FROM events WHERE user_id IN (SELECT o_orderkey FROM orders)",
}


@pytest.mark.parametrize("name", sorted(KEYS))
def test_every_session(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = {k for (k,) in con.execute(KEYS[name]).fetchall()}
    got = {r.session_key for r in QUERIES[f"all_sessions_{name}"](spark, DATA).select("session_key").distinct().collect()}
    assert got == want
    if name not in ("tools", "turns"):  # events name few of the sessions
        assert max(want) > 200
