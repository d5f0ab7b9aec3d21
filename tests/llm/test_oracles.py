import pytest
from oracle import compare, duck

from tidelight.llm import queries


@pytest.fixture(scope="module")
def con():
    return duck("sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, con, name):
    ok, said = compare(spark, con, queries.QUERIES[name], queries.ORACLE[name], "sf0.001")
    assert ok, said
