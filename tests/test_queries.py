"""Every registered query runs and equals its SQL twin at the smallest scale."""

import pytest
from compare import connection, difference
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries

SQLS = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SMALL)


def test_every_sql_has_a_query():
    assert set(SQLS) <= set(queries())


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    frame = queries()[name](spark, SMALL)
    if name in SQLS:
        assert difference(frame, con, SQLS[name]) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    assert entry(spark).columns == ["topic", "group", "class", "term", "n"]
