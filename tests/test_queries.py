import os

import pytest

from matrixframe import queries
from tests.oracle import DATA, assert_same

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="the shared tables aren't here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_oracle(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["error_rate"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
