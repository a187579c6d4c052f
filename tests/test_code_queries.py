"""The queries over code, held against DuckDB; the place of rows is a column where order is the point."""

from __future__ import annotations

import pytest

from sparkloom.plans import code, sources  # noqa: F401
from sparkloom.plans.queries import ORACLES, QUERIES
from tests.oracle import compare, connect
from tests.test_queries import SF

NAMES = sorted(n for n, f in QUERIES.items() if f.module in ("sparkloom.plans.code", "sparkloom.plans.sources"))


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_duckdb(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLES[name]) > 0, "a query that finds nothing checks nothing"
