"""Every registered query with SQL gives the SQL's rows."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from pressgauge.plans.oracles import ORACLES
from pressgauge.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rows_only_queries_run(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, SF).count() > 0, name


def test_entry(spark):
    assert entry.entry(spark).count() > 0
