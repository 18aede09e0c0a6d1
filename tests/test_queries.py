"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from pickwise.plans import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"  # where shares of the rows no longer round to one
registry.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    problem = compare(spark, con, SF, name, registry.QUERIES[name], registry.ORACLES.get(name))
    assert problem in (None, "no rows"), problem


def test_every_oracle_has_its_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", ["enrichment_campaign"])
def test_query_on_more_rows(spark, name):
    assert compare(spark, connect(LARGER), LARGER, name, registry.QUERIES[name], registry.ORACLES[name]) is None


def test_guided_strategies_beat_the_random_one(spark):
    from pickwise.plans.selection_queries import enrichment

    found = {r.strategy: r.top1_recall for r in enrichment(spark, LARGER).collect()}
    assert min(found["greedy"], found["ucb"]) >= found["random"]
