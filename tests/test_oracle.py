"""Every query with comparison SQL gives the same rows, on the smallest tables.

``ORACLE_SF_DIR`` selects other tables.
"""

import os

import pytest

import __spark_entry__ as contract
from suite.compare import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    assert compare(spark, duck, SF, name, contract.queries()[name], ORACLES[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["item", "forecast_week_start", "model_used", "y_hat"]
    assert df.count() > 0
