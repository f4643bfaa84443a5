"""Every query against its SQL equivalent, and the driver contract."""

import pytest

import __spark_entry__ as entry
from tessella import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(name, spark, data_dir, duck, same):
    got = catalogue.QUERIES[name](spark, data_dir).toPandas()
    assert name in catalogue.ORACLES
    same(got, duck.execute(catalogue.ORACLES[name]).df())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
