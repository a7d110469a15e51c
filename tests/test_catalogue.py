import pytest

from compare import same
from hushframe.plans import catalogue, more


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_the_other_engine(spark, small, name):
    same(catalogue.QUERIES[name](spark, small), catalogue.ORACLE_SQL[name], small)


def test_all_modules_register(spark):
    assert set(more.NAMES) < set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
