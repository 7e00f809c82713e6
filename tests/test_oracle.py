"""Every registered query against its SQL text (FLEETWATT_SF_DIR picks the data, sf0.001 by default)."""

import oracle
import pytest

import __spark_entry__ as entry

NAMES = sorted(entry.queries())

#: queries without a row on the smallest tables
MAY_BE_EMPTY: set[str] = set()


@pytest.fixture(scope="module")
def con(sf):
    return oracle.duck(sf)


def test_contract():
    assert set(entry.oracle_sql()) <= set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, sf, con):
    df = entry.queries()[name](spark, sf)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        df.count()
        return
    diff = oracle.compare(df, sql, con)
    assert diff is None or diff == "no rows" and name in MAY_BE_EMPTY, diff


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "device" and df.count() > 0
