import pytest

from tests.helpers import assert_same, connect
from trovelode.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_what_its_sql_gives(spark, data, name):
    assert_same(queries.QUERIES[name](spark, data), connect(data), queries.SQL[name])
