"""Operator queries that SQL can express, against their twins."""

import pytest
from oracle_check import connect, differences

from boardpulse.llm.oracle import ORACLE
from boardpulse.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert differences(QUERIES[name](spark, sf), connect(sf), ORACLE[name]) == []
