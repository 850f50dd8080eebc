"""Every registered query against its SQL; the others run and return rows."""

import pytest

import __spark_entry__ as entry
from factloom.plans import catalog
from tests.helpers import same_as_sql


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, data, name):
    df = catalog.QUERIES[name](spark, data)
    if name in catalog.ORACLES:
        same_as_sql(df, duck, catalog.ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
