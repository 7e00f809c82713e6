"""The physical plans stay what they were designed to be."""

import re

from pyspark.sql import functions as F

from fleetwatt.operators import joins as J
from fleetwatt.operators import meters as M
from fleetwatt.operators import windows as W
from fleetwatt.plans import load_all
from fleetwatt.plans.telemetry import samples


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text: str) -> list[str]:
    return re.findall(r"Exchange (\w+\([^)]*\))", text)


def test_meters_read_and_shuffle_once(spark, sf):
    text = plan(load_all()[0]["energy_meters"](spark, sf))
    assert text.count("FileScan") == 1
    got = shuffles(text)
    assert len(got) == 2 and "__slice" in got[1] and "__slice" not in got[0]  # by slice, then the sums by device
    assert text.count("Sort [") == 1


def test_no_window_over_a_whole_device_of_samples(spark, sf):
    """Windows by device alone may only run over slice summaries."""
    text = plan(W.soc_latch(samples(spark, sf), 90, 70))
    for line in text.splitlines():
        if "Window [" in line and "__slice" not in line:
            raise AssertionError(line)


def test_columns_and_filters_reach_the_scan(spark, sf):
    df = samples(spark, sf).filter(F.col("event_type") == "error").select("device", "ts", "event_id", "current")
    text = plan(W.outages(df.select("device", "ts", "event_id"), 3600.0))
    assert "EqualTo(event_type,error)" in text
    for schema in re.findall(r"ReadSchema: struct<([^>]*)", text):
        assert "props" not in schema and "value" not in schema


def test_asof_with_age_limit_reads_once(spark, sf):
    df = samples(spark, sf).select("event_id", "device", "ts", "current")
    text = plan(J.fill_slow_fields(df, df.withColumnRenamed("current", "x"), ("x",), 30.0))
    assert text.count("FileScan") == 2 and "Join" not in text


def test_no_cross_join_and_no_blind_broadcast(spark, sf):
    for name in ("ambient_asof", "group_rollup", "classify_protocol", "bit_diff", "entity_catalog"):
        text = plan(load_all()[0][name](spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
    # the meters never join at all
    assert "Join" not in plan(M.meter_increments(samples(spark, sf).withColumn("power", F.lit(1.0)), 600.0))
