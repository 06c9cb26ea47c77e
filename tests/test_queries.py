"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from checks.oracle import oracle_sql
from checks.spark_queries import queries
from checks.verify import difference

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, name):
    assert difference(spark, FOLDER, name) is None


def test_entry(spark):
    import __spark_entry__ as driver

    found = driver.entry(spark)
    assert found.count() > 0
    assert set(queries()) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())
