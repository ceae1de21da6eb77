"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as spark_entry
from codequarry import catalog
from tests.comparing import compare, oracle_connection

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The corpus queries have tests of their own, beside their subpackage.
QUERIES = {name: run for name, run in spark_entry.queries().items() if name in catalog.load()}
ORACLE = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    verdict = compare(QUERIES[name](spark, FOLDER), oracle, ORACLE.get(name))
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert spark_entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(spark_entry.queries())
