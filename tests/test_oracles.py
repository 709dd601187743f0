"""Registered queries against DuckDB on the smallest tables.

`python tests/check_oracles.py` does the same with timings.  The corpus
operators have their own tests in tests/llm.
"""

import check_oracles as co
import pytest

import __spark_entry__ as entry
from bourse.plans import load

SF = "/root/testdata/sf0.001"
ORACLES = load()[1]


@pytest.fixture(scope="module")
def con():
    return co.duck(SF)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_oracle(spark, con, key):
    assert co.compare(entry.queries()[key](spark, SF), con, ORACLES[key]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["ticker", "final_return", "made_money"] and df.count() == 25
