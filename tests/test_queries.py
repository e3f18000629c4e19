"""Every query of the core against its SQL at the smallest scale; those without SQL run and keep their schema."""

import pytest

from gradus.plans import catalog

from .oracle import assert_same

D = "/root/testdata/sf0.001"
SQL, QUERIES = catalog.oracle_sql(), catalog.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert_same(QUERIES[name](spark, D), D, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, D).columns


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["src", "dst", "s_corr", "forward"]
