"""Every registered query against its SQL on another engine."""

import pytest

import __spark_entry__ as entry
from defectlens.plans import registry
from tools.check import compare, connect

CHECKS = entry.oracle_sql()
NAMES = list(registry.callables())


@pytest.fixture(scope="module")
def con(data_dir):
    return connect(data_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, data_dir, name):
    df = entry.queries()[name](spark, data_dir)
    if name in CHECKS:
        assert compare(df, con, CHECKS[name]) is None
    else:
        assert df.count() > 0


def test_every_query_is_checked():
    assert set(NAMES) <= set(CHECKS)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 3 and "mrr" in df.columns
