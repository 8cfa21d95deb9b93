"""Every registered query against its SQL twin, on whole test tables."""

import pytest
from oracle_check import connect, differences

import __spark_entry__ as entry_module
from boardpulse.oracle import ORACLE
from boardpulse.registry import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert differences(QUERIES[name](spark, sf_dir), duck, ORACLE[name]) == []


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() > 0
