"""The numbered queries against their SQL twins on the smallest tables."""

import pytest

from pickwise.llm import queries
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, SF, name, queries.QUERIES[name], queries.ORACLES.get(name))
    assert problem in (None, "no rows"), problem


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
