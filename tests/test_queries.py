"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from foliolake.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(name, spark, tiny, against_sql):
    against_sql(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], tiny)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(name, spark, tiny):
    assert catalog.QUERIES[name](spark, tiny).count() > 0


def test_entry(spark, tiny):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
