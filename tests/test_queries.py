"""Every query of the sequence operators against its SQL."""

import pytest
from conftest import shown

from lodestrand import file_queries, queries

QUERIES, ORACLE_SQL = queries.QUERIES | file_queries.QUERIES, queries.ORACLE_SQL | file_queries.ORACLE_SQL


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert shown(QUERIES[name](spark, sf_dir).toPandas()) == shown(duck.sql(ORACLE_SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
