"""Every query with SQL, whole results against an independent engine."""

import pytest

import __spark_entry__ as driver
import oracle

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_matches_sql(spark, name):
    rows, difference = oracle.compare(spark, SMALL, driver.queries()[name], driver.oracle_sql()[name])
    assert difference == ""
    assert rows > 0


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_has_a_forecast_per_count(spark):
    frame = driver.entry(spark)
    assert frame.columns == ["location", "time_ms", "predicted_counts"]
    assert frame.count() == 960
