"""Every query with SQL gives what the SQL gives; the others give rows with a stable schema."""

import pytest

from loomline import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(name, spark, sf, duck, equal):
    equal(Q.QUERIES[name](spark, sf), duck.sql(Q.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_rows_only(name, spark, sf):
    one, two = Q.QUERIES[name](spark, sf), Q.QUERIES[name](spark, sf)
    assert one.schema == two.schema
    rows = sorted(map(str, one.collect()))
    assert rows and rows == sorted(map(str, two.collect()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
