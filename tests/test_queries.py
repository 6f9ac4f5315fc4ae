"""Every registered query against its SQL, on the smallest tables."""

import pytest
from oracle import connect, differences

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    df = entry(spark)
    assert df.count() > 0
    assert "is_tpr_gap_significant" in df.columns


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_sql(spark, con, name):
    assert differences(queries()[name](spark, SF), con, oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    df = queries()[name](spark, SF)
    assert df.columns
    df.count()
