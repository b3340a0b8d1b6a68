import pytest

from pagequarry.llm.queries import oracle_sql, queries

from ..oracle import SF, connection, difference


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    assert difference(queries()[name](spark, SF), connection(), oracle_sql()[name]) is None
