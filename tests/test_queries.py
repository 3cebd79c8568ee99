"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, differences

from photarium.registry.oracles import ORACLES
from photarium.registry.queries import QUERIES

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = queries()[name](spark, SF_DIR)
    assert differences(df, con, oracle_sql()[name]) == []


def test_entry(spark):
    assert entry(spark).count() > 0
