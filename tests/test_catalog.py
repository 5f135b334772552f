"""Every query against its SQL twin, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import connect, differences

from quillmill.plans import catalog

QUERIES, ORACLES = catalog.load()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
