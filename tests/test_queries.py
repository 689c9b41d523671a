"""Every named query against its DuckDB SQL on the smallest data set."""

import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from flowscope.operators.loglog import approx_unique_flows
from flowscope.plans.inputs import flows
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
ORACLE = oracle_sql()
NAMES = sorted(n for n in queries() if not re.match(r"op\d+_|pipeline$", n))  # those have tests of their own
ROWS_ONLY: set[str] = set()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_check():
    assert set(NAMES) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    df = queries()[name](spark, SF)
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_approximate_counts_are_close(spark):
    exact = queries()["distinct_flow_keys"](spark, SF).count()
    row = approx_unique_flows(flows(spark, SF)).first()
    assert row.exact == exact
    assert abs(row.approx_flows - exact) <= 0.05 * exact
    assert abs(row.datasketch_flows - exact) <= 0.05 * exact
