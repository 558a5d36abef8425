"""Every registered query of the library against its SQL."""

import pytest

from pastcast import plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, same_as_sql, name):
    df = plans.QUERIES[name](spark, sf_dir)
    if name in plans.ORACLES:
        same_as_sql(df, plans.ORACLES[name], sf_dir)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
