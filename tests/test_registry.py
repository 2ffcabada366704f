import pytest

from sparkquarry.plans import stage_queries  # noqa: F401  adds its queries
from sparkquarry.plans.registry import QUERIES, SQL
from tests.twins import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, name):
    compare(spark, sf_dir, QUERIES[name], SQL[name])


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert rows.count() > 0 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
