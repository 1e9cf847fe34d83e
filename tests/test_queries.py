"""Every registered query against its SQL, on the smallest tables."""

import pytest
from tests.compare import answer, oracle

from tallgrass import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert answer(registry.QUERIES[name](spark, sf_dir)) == oracle(registry.ORACLES[name], sf_dir)


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLES.keys()))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["fy", "scope1", "scope2_location", "scope2_market", "scope3", "total"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
