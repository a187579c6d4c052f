"""Every registered query of the reference's own operators over sf0.001, against DuckDB where SQL can express it."""

from __future__ import annotations

import os

import pytest

from sparkloom.plans.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


OWN = {n for n, f in QUERIES.items() if f.module == "sparkloom.plans.queries"}


@pytest.mark.parametrize("name", sorted(OWN & set(ORACLES)))
def test_same_as_duckdb(spark, con, name):
    compare(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(OWN - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
