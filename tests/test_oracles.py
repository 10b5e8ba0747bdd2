"""Every registered query of the execution-state operators against its SQL."""

import pytest

from tests.oracle import assert_same
from tidemark.plans.oracles import ORACLES
from tidemark.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLES[name], SMALL)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).columns
    assert {"watchdog_verdict", "expired_leases"} <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
