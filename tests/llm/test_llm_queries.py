"""Every query of the subpackage at the smallest scale, against its SQL where it has one."""

import pytest

from graphloom.llm import queries as _queries  # noqa: F401
from graphloom.llm.registry import ORACLES, QUERIES

from ..check import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_names():
    import __spark_entry__ as entry

    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        ok, note = compare(df, con, ORACLES[name])
        assert ok, note
    else:
        assert len(df.collect()) > 0
