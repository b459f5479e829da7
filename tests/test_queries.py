import pytest

from tests.helpers import assert_same, connect
from trovelode.plans import registry


@pytest.fixture(scope="module")
def connection(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_gives_what_its_sql_gives(spark, data, connection, name):
    assert_same(registry.QUERIES[name](spark, data), connection, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["file_path", "start_line", "end_line", "code_chunk", "score", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_imports_the_llm_package():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "trovelode"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "trovelode.llm" not in path.read_text(), path
