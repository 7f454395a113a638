"""Queries that SQL can express, against DuckDB on whole tables."""

import pytest

from lodestar.llm import registry
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_its_sql(spark, data, name):
    sf = f"{data}/sf0.001"
    assert_same(registry.queries()[name](spark, sf), sf, registry.oracle_sql()[name])


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 11)]
