"""Scans and folds over range partitions give what a sequential pass gives, however rows fall into runs and batches."""

import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetwatt.operators import folds as O
from fleetwatt.operators import prefix
from fleetwatt.operators.timeline import Timeline
from fleetwatt.plans import load_all

ONE_DAY = 86_400


@pytest.fixture(scope="module")
def rows(spark):
    """One device with a day that holds a third of all rows, many small ones, one without a name; values are often missing."""
    rnd = random.Random(3)
    out = []
    for i in range(1800):
        device = "hot" if i % 3 == 0 else rnd.choice(["a", "b", None, *[f"d{k}" for k in range(40)]])
        at = rnd.uniform(0, ONE_DAY) if device == "hot" else rnd.uniform(0, 30 * ONE_DAY)
        out.append((i, device, at, rnd.choice([None, None, rnd.uniform(-5, 5)]), rnd.choice([None, rnd.randint(-9, 9)]), rnd.choice([None, "x", "y"])))
    df = spark.createDataFrame(out, "event_id bigint, device string, at double, v double, n int, s string")
    return df.withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("bigint"))).drop("at").cache()


@pytest.fixture(params=[10_000, 7])
def batch(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def values(df):
    canon = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    return {r["event_id"]: tuple(canon(v) for v in r) for r in df.collect()}


@pytest.mark.parametrize("runs", [1, 5, 60])
def test_running_columns(rows, batch, runs):
    pair = F.when(F.col("v").isNotNull(), F.struct("v", "s"))
    got = prefix.scan(
        prefix.in_runs(rows, runs=runs),
        lag={"a": F.col("v"), "b": F.struct("n", "s")}, last={"c": F.col("s"), "d": pair}, last_before={"e": F.col("v"), "f": F.col("ts")},
        total={"g": F.col("v"), "h": F.col("n")}, total_before={"i": F.col("n"), "j": F.col("v")},
        high={"k": F.col("n"), "l": F.col("v")}, low={"m": F.col("v")}, high_before={"o": F.col("v")}, low_before={"p": F.col("n")},
    )
    w = Window.partitionBy("device").orderBy("ts", "event_id")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c, w: F.last(c, ignorenulls=True).over(w)
    want = rows.select(
        "event_id", F.lag("v").over(w).alias("a"), F.lag(F.struct("n", "s")).over(w).alias("b"), last("s", upto).alias("c"), last(pair, upto).alias("d"),
        last("v", before).alias("e"), last("ts", before).alias("f"), F.sum("v").over(upto).alias("g"), F.sum("n").over(upto).alias("h"), F.sum("n").over(before).alias("i"),
        F.sum("v").over(before).alias("j"), F.max("n").over(upto).alias("k"), F.max("v").over(upto).alias("l"), F.min("v").over(upto).alias("m"), F.max("v").over(before).alias("o"), F.min("n").over(before).alias("p"),
    )
    assert values(got.select(want.columns)) == values(want)
    assert [f.dataType for f in got.select(want.columns).schema] == [f.dataType for f in want.schema]


def test_a_hot_day_is_dealt_over_tasks(rows):
    cut = prefix.in_runs(rows, runs=30)
    size = [r["count"] for r in cut.groupBy(prefix.RUN).count().collect()]
    assert len(size) == 30 and max(size) < 3 * 1800 / 30
    hot = cut.filter("device = 'hot'").agg(F.countDistinct(prefix.RUN)).first()[0]
    assert hot >= 8
    # a run ends where the next begins
    ends = cut.groupBy(prefix.RUN).agg(F.min(F.struct("device", "ts", "event_id")).alias("lo"), F.max(F.struct("device", "ts", "event_id")).alias("hi")).orderBy(prefix.RUN).collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(ends, ends[1:], strict=False) if a["hi"]["device"] is not None)


def test_scans_in_a_row_and_filters_between(rows, batch):
    df = prefix.in_runs(rows, runs=12)
    df = prefix.scan(df, lag={"p": F.col("v")}).filter("p is not null")
    df = prefix.scan(df, total={"t": F.col("p")}).filter("event_id % 3 <> 1")
    got = prefix.scan(df, lag={"q": F.col("t")})
    w = Window.partitionBy("device").orderBy("ts", "event_id")
    want = rows.withColumn("p", F.lag("v").over(w)).filter("p is not null").withColumn("t", F.sum("p").over(w)).filter("event_id % 3 <> 1").withColumn("q", F.lag("t").over(w))
    cols = ["event_id", "p", "t", "q"]
    assert values(got.select(cols)) == values(want.select(cols))


@pytest.mark.parametrize("name", ["ewma", "zscore", "quantize", "throttle", "keepalive", "pack", "periods"])
def test_folds(rows, batch, name):
    v = F.col("v")
    few = rows.filter("event_id % 2 = 0")
    run = {
        "ewma": lambda df: O.ewma(df, v, 6),
        "zscore": lambda df: O.ewm_zscore(df, v, 12),
        "quantize": lambda df: O.quantize(df, v, 0.5, 2),
        "throttle": lambda df: O.throttle(df, 4000.0),
        "keepalive": lambda df: O.keepalive_dedup(df.withColumn("topic", F.col("s")).withColumn("value", F.col("n"))),
        "pack": lambda df: O.pack_temperature(df.withColumn("mos_temperature", v * 3).withColumn("room", F.col("n").cast("double")).withColumn("outdoor", F.lit(None).cast("double"))),
        "periods": lambda df: O.publish_decision(df.withColumns({"jump_hold": F.lit(False), "power": v}), 4000.0),
    }[name]
    tl = Timeline(("device", "topic")) if name == "keepalive" else Timeline()
    prepared = few.withColumn("topic", F.col("s")) if name == "keepalive" else few
    assert values(run(prefix.in_runs(prepared, tl, runs=17)).drop(prefix.RUN)) == values(run(prefix.in_runs(prepared, tl, runs=1)).drop(prefix.RUN))


def final_exchanges(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    text = text.split("== Initial Plan ==")[0]
    return re.findall(r"(?<!Broadcast)Exchange \w+", "\n".join(x for x in text.splitlines() if "ReusedExchange" not in x))


@pytest.mark.parametrize("name", ["daily_utility_meter", "publish_decision", "meter_readings", "weakest_cell"])
def test_scans_in_a_row_share_one_shuffle(spark, sf, name):
    got = final_exchanges(load_all()[0][name](spark, sf))
    assert len(got) <= 4, got


def test_rows_that_change_between_reads_stop_the_job():
    """Heads and rows come from two reads; a source that gives other rows must not go unseen."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"device": "a", "ts": 1, "__a0": "a", "__a1": 2}])
    with pytest.raises(RuntimeError, match="same at each read"):
        prefix._checked(batch, ["device", "ts"])


def test_nothing_in_nothing_out(rows):
    none = rows.filter("false")
    assert prefix.scan(none, lag={"p": F.col("v")}).collect() == []
    assert O.ewma(none, F.col("v"), 6).collect() == []


def test_a_slice_too_large_for_a_task_goes_in_runs(spark, rows, monkeypatch):
    """Meters and as-of joins with an age limit: the same rows either way, and no slice in the plan if one is hot."""
    from fleetwatt.operators import joins, meters, timeline

    df = rows.filter("device is not null").select("event_id", "device", "ts", F.col("v").alias("current"), (F.col("v") * 50).alias("power"), F.col("n").cast("double").alias("soc"), F.col("n").cast("double").alias("charge"))
    side = df.filter("event_id % 4 = 0").select("event_id", "device", "ts", F.col("current").alias("x"))

    def both():
        inc = meters.meter_increments(df, 3600.0)
        return inc, joins.fill_slow_fields(df, side, ("x",), 900.0)

    cold = both()
    monkeypatch.setattr(timeline.has_hot_slice, "__defaults__", (timeline.DEVICE_TIME, 50))
    hot = both()
    for a, b in zip(cold, hot, strict=True):
        assert "__slice" in a._jdf.queryExecution().executedPlan().toString() and "__slice" not in b._jdf.queryExecution().executedPlan().toString()
        cols = sorted(a.columns)
        assert sorted(b.columns) == cols
        assert values(a.select("event_id", *cols)) == values(b.select("event_id", *cols))
