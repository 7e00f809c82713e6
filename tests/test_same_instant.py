"""Several events of one device at one instant, as in tables that are repeated with shifted keys."""

import os

import duckdb
import pytest

import __spark_entry__
from oracle import TABLES, compare, duck


@pytest.fixture(scope="module")
def doubled(sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("doubled")
    for t in TABLES:
        if t != "events":
            os.symlink(f"{sf}/{t}.parquet", root / f"{t}.parquet")
    rows = f"SELECT e.* REPLACE (e.event_id + i * 100000 AS event_id, e.user_id + i * 1500 AS user_id) FROM range(2) r(i), '{sf}/events.parquet' e"
    duckdb.sql(f"COPY ({rows} ORDER BY i, event_id) TO '{root}/events.parquet' (FORMAT parquet)")
    return str(root)


@pytest.mark.parametrize("name", ["stream_late"])
def test_same_instant(spark, doubled, name):
    df = __spark_entry__.queries()[name](spark, doubled)
    assert compare(df, __spark_entry__.oracle_sql()[name], duck(doubled)) is None
