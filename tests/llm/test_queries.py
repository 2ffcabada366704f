import pytest

from sparkquarry.llm import queries
from tests.twins import compare


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    compare(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


def test_all_queries():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 14)]
