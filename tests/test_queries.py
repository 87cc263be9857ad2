"""Every registered query runs; those with SQL are equal to it on the smallest tables."""

import pytest

from quarry.plans import catalog
from tests.compare import same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    if name in catalog.ORACLE_SQL:
        same(df, catalog.ORACLE_SQL[name], DATA)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
