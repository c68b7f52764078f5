"""Queries of this subpackage against SQL on whole small tables."""

import pytest
from oracle import assert_same, by_sql

from muster.llm import registry


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_matches_sql(spark, name):
    sf = "/root/testdata/sf0.01" if name != "op2_quality_rules" else "/root/testdata/sf0.001"
    assert_same(registry.queries()[name](spark, sf).toPandas(), by_sql(registry.oracle_sql()[name], sf))
