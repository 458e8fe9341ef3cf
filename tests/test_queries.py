"""Every registered query of the reference's own operators against its SQL, or for columns and rows where it has none."""

import pytest

from tideline.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same):
    same(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_entry():
    import __spark_entry__ as e

    assert set(SQL) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
