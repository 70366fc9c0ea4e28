"""Every registered query of the timed-text operators: against its SQL, or that it runs."""

import pytest

from timedtext import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, same, name):
    same(queries.QUERIES[name](spark, sf), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_has_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).take(1)


def test_entry(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
