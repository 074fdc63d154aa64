"""Every query with SQL gives the SQL's result on the smallest data; the others run."""

import pytest

import __spark_entry__ as entry
from marlgrid.queries import core, problems
from tests.compare import canonical, connect, expected

NAMES = [*core.QUERIES, *problems.QUERIES]


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, data, duck, name):
    df = entry.queries()[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql:
        assert canonical(df.columns, rows) == expected(duck, sql)
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
