"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from corpusmill.plans import registry
from tests.compare import duck, same

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    ok, said = same(spark, con, registry.queries()[name], SQL[name], SF)
    assert ok, said


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    registry.queries()[name](spark, SF).count()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
