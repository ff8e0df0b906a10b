"""Every registered plan runs; those with a SQL twin give the same rows."""

import os

import pytest
from conftest import MEDIUM
from oracle import connect, differences

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(MEDIUM)


def test_entry(spark):
    assert entry.entry(spark).count() == 24


def test_twins_belong_to_plans():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, con, name):
    rows = QUERIES[name](spark, MEDIUM).toPandas()
    assert len(rows)
    if name in ORACLES:
        assert differences(rows, con.execute(ORACLES[name]).df()) is None


SMALL_BLOCKS = ["rle_all", "merge_intervals", "quantiles", "missing_samples", "sliding_vectors", "cume_dist_by_key", "digest_tree", "lorenz"]


@pytest.mark.skipif(not os.path.isdir(MEDIUM), reason="test tables not present")
@pytest.mark.parametrize("name", SMALL_BLOCKS)
def test_plan_with_small_blocks(spark, con, name):
    """The same rows when nearly every group is cut into blocks."""
    spark.conf.set("spark.residua.rowsPerBlock", "60")
    try:
        rows = QUERIES[name](spark, MEDIUM).toPandas()
    finally:
        spark.conf.unset("spark.residua.rowsPerBlock")
    assert differences(rows, con.execute(ORACLES[name]).df()) is None
