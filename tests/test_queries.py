"""Every registered query against its SQL in DuckDB."""

import pytest

from wellspark.checks import REGISTRY
from wellspark.checks.compare import connect, difference


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql is not None])
def test_query_equals_sql(spark, folder, duck, name):
    run, sql = REGISTRY[name]
    assert difference(run(spark, folder), duck, sql) is None


def test_entry_module(spark, folder):
    import __spark_entry__ as entry

    own = set(REGISTRY)
    assert own <= set(entry.queries())
    assert own <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
