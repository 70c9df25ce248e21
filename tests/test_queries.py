from __future__ import annotations

import pytest
from conftest import DATA

from pairloom.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, str(DATA)), SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
