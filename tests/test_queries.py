"""Every registered query against its SQL on the test tables."""

from __future__ import annotations

import pytest
from compare import assert_same

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, data_dir, name):
    result = QUERIES[name](spark, data_dir)
    if name in SQL:
        assert_same(result, duck.sql(SQL[name]))
    else:
        assert result.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
