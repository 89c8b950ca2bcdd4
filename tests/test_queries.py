"""Every registered query against its SQL on the smallest tables."""

import pytest

from evalweave.queries import QUERIES, SQL
from tests.conftest import SMALL
from tools.check import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert name in SQL
    assert compare(spark, con, name, SMALL) == ""


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["scope", "name", "passed", "total", "pass_at_1"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
