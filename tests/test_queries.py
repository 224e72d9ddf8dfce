"""Every registered query runs; those with SQL agree with it on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    if name in SQL:
        assert compare(QUERIES[name], SQL[name], spark, small, connect(small)) is None
    else:
        assert QUERIES[name](spark, small).limit(5).count() > 0
