"""Every registered query of the raster engine against its SQL, or for a result where there is no SQL."""

from __future__ import annotations

import pytest

from pixelweave.plans.all import ORACLES, QUERIES
from tests.compare import connect, rows_of


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    ref = con.execute(ORACLES[name])
    want = rows_of([d[0] for d in ref.description], ref.fetchall())
    assert sorted(df.columns) == sorted(d[0] for d in ref.description)
    assert got == want


def test_entry_names_are_consistent():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(QUERIES) <= set(e.queries())
