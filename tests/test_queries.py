"""Every registered query of the engine against its oracle on the smallest tables."""

from __future__ import annotations

import pytest

from jobtide import catalog

from .oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, sf_dir, name):
    if name in catalog.ORACLE:
        compare(spark, con, sf_dir, catalog.QUERIES[name], catalog.ORACLE[name])
    else:
        catalog.QUERIES[name](spark, sf_dir).collect()


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
