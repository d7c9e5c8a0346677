"""Every query that has SQL, against DuckDB on the small tables."""

from __future__ import annotations

import pytest
from oracle_check import connect, normal

from rollcall.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(ORACLES[name])
    want = normal([c[0] for c in result.description], result.fetchall())
    assert got == want and got[1]
