import pytest

import __spark_entry__ as driver
from workload.check import connect, difference

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_matches_sql(spark, tables, name):
    sql = driver.oracle_sql()[name]
    assert difference(driver.queries()[name](spark, SMALL), tables, sql) is None


def test_entry(spark):
    assert driver.entry(spark).count() > 0
