"""Every registered query against its SQL twin, over whole tables."""

import os

import pytest
from compare import assert_same, connect

import __spark_entry__ as contract
from adkpi.registry.oracle import ORACLE
from adkpi.registry.queries import QUERIES

SF_DIR = os.environ.get("ADKPI_TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert QUERIES.keys() == ORACLE.keys()
    assert QUERIES.keys() <= contract.queries().keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    assert_same(contract.queries()[name](spark, SF_DIR), duck, contract.oracle_sql()[name])


def test_entry(spark):
    assert contract.entry(spark).count() > 0
