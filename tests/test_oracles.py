"""Every registered query with SQL against DuckDB."""

import pytest
from compare import assert_same

from lorewright.plans import core

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query(spark, name):
    assert_same(core.QUERIES[name](spark, SF), core.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_query_runs(spark, name):
    assert core.QUERIES[name](spark, SF).columns


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
