"""Every registered query against its SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from graphloom.plans.registry import ORACLES, QUERIES

from .check import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        ok, note = compare(df, con, ORACLES[name])
        assert ok, note
    else:
        assert len(df.collect()) > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["corpus", "beta_idx", "mean_s", "std_s", "n_curves"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
