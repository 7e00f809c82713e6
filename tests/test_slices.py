"""Slicing must not show: any slice width, and hot slices cut finer, give the unsliced result."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from fleetwatt.operators import folds as O
from fleetwatt.operators import meters as M
from fleetwatt.operators import windows as W
from fleetwatt.operators.timeline import DEVICE_TIME, balanced, slice_sizes
from fleetwatt.plans.telemetry import samples

WHOLE = replace(DEVICE_TIME, width_s=10**9)
NARROW = replace(DEVICE_TIME, width_s=30_000)


@pytest.fixture(scope="module")
def skewed(spark, sf):
    """One device owns most rows."""
    df = samples(spark, sf).withColumn("device", F.when(F.col("event_id") % 10 < 8, F.lit("hot")).otherwise(F.col("device")))
    return df.withColumn("power", F.col("voltage") * F.col("current")).cache()


def table(df, *cols):
    def canon(v):
        return round(v, 7) + 0.0 if isinstance(v, float) else str(v)

    return sorted((tuple(canon(v) for v in r) for r in df.select("event_id", *cols).collect()), key=repr)


OPERATORS = {
    "readings": (lambda df, tl: M.meter_readings(M.meter_increments(df, 7200.0, tl=tl), tl), M.METERS),
    "integrate": (lambda df, tl: M.integrate(df, F.col("power"), 36_000.0, "reading", tl), ("reading",)),
    "jump": (lambda df, tl: W.power_jump(df, hold_s=3600.0, tl=tl), ("jump", "jump_hold")),
    "changed": (lambda df, tl: W.changed_only(df.withColumn("level", F.floor(F.col("soc") / 25)), ("level",), tl=tl), ("level",)),
    "latch": (lambda df, tl: W.soc_latch(df, 90, 20, tl=tl), ("charging",)),
    "weakest": (lambda df, tl: W.weakest_cell(df, tl=tl), ("weakest_cell",)),
    "segments": (lambda df, tl: W.segments(df, 3600.0, tl=tl), ("segment",)),
    "ewma": (lambda df, tl: O.ewma(df, F.col("current"), 6, tl=tl), ("ewma",)),
    "throttle": (lambda df, tl: O.throttle(df, 4000.0, tl=tl), ("kept",)),
    "runtime": (lambda df, tl: O.runtime(df, tl), ("runtime",)),
    "quantize": (lambda df, tl: O.quantize(df, F.col("mos_temperature"), 1.0, 4, tl=tl), ("quantized",)),
    "periods": (lambda df, tl: O.publish_decision(df.withColumn("jump_hold", F.lit(False)), 4000.0, tl=tl), ("publish",)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_narrow_and_hot(spark, skewed, name):
    run, cols = OPERATORS[name]
    want = table(run(skewed, WHOLE), *cols)
    assert table(run(skewed, NARROW), *cols) == want
    hot = balanced(skewed, replace(DEVICE_TIME, width_s=400_000), max_rows=20)
    assert hot.hot is not None
    assert table(run(skewed, hot), *cols) == want


def test_balanced_bounds_the_slices(spark, skewed):
    tl = replace(DEVICE_TIME, width_s=400_000)
    assert slice_sizes(skewed, tl).agg(F.max("rows")).first()[0] > 60
    cut = balanced(skewed, tl, max_rows=20).sliced(skewed).groupBy("device", "__slice").count()
    assert cut.agg(F.max("count")).first()[0] <= 40
    assert balanced(skewed, tl, max_rows=10**6).hot is None


def test_settles_when_nothing_is_forgotten(spark, skewed):
    """A fold that remembers everything needs a round per slice, and still ends with the right rows."""
    from fleetwatt.operators.fold import Fold, run_fold

    class Count(Fold):
        inputs, output = ("x",), "n long"

        def init(self):
            return 0

        def step(self, state, row):
            return state + 1, (state + 1,)

    tl = replace(DEVICE_TIME, width_s=400_000)
    df = skewed.select("device", "ts", "event_id")
    got = run_fold(df, Count(), {"x": F.lit(1)}, tl)
    want = {r.event_id: r.n for r in df.selectExpr("event_id", "row_number() over (partition by device order by ts, event_id) n").collect()}
    assert {r.event_id: r.n for r in got.collect()} == want
