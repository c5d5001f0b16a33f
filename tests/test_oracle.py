"""Every registered query against its SQL twin on the given tables."""

import os

import oracle
import pytest

import __spark_entry__ as driver
from ledgerweave.star.queries import QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip(f"no tables in {FOLDER}")
    return oracle.connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(QUERIES) <= set(driver.queries())
    assert set(QUERIES) <= set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    difference = oracle.compare(driver.queries()[name](spark, FOLDER), con, driver.oracle_sql()[name])
    assert difference is None


def test_the_comparison_can_fail(spark, con):
    wrong = driver.oracle_sql()["flag_count"].replace("'F'", "'O'")
    assert oracle.compare(driver.queries()["flag_count"](spark, FOLDER), con, wrong)


def test_entry(spark):
    assert driver.entry(spark).columns == ["group_name", "order_count"]
