"""Files in and out."""

import json
import math
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetwatt.operators import windows as W
from fleetwatt.plans.telemetry import OPTIONS, samples
from fleetwatt.sinks import points as P
from fleetwatt.sources import readers as R

T0 = datetime(2024, 1, 1)


def test_read_samples(spark, tmp_path):
    rows = [("d", T0, 12.0, math.nan, [1.0, math.nan]), ("d", T0 + timedelta(seconds=1), math.nan, 2.0, None)]
    spark.createDataFrame(rows, "device string, ts timestamp, voltage double, current double, temperatures array<double>").write.parquet(str(tmp_path / "s"))
    got = R.read_samples(spark, str(tmp_path / "s")).orderBy("ts").collect()
    assert (got[0].current, list(got[0].temperatures), got[1].voltage, got[1].soc) == (None, [1.0, None], None, None)


def test_read_devices_and_groups(spark, tmp_path):
    path = tmp_path / "options.json"
    path.write_text(json.dumps(OPTIONS, indent=2))
    devices = R.read_devices(spark, str(path))
    got = {r.device: r for r in devices.collect()}
    assert set(got) == {"bms0", "bms1", "bms2", "bms3", "g0", "g1"}
    assert got["bms1"].type == "jk" and got["bms1"].spec == "v2"
    assert got["bms3"].current_calibration == 1.0 and list(got["bms3"].algorithms) == ["soc 90% 70%", "soc 80%"]
    members = [(r.group, r.member, r.ord) for r in R.read_group_members(devices).orderBy("group", "ord").collect()]
    assert members == [("g0", "bms0", 0), ("g0", "bms1", 1), ("g1", "bms2", 0), ("g1", "bms3", 1)]


def test_partitioned_writer_prunes(spark, sf, tmp_path):
    df = samples(spark, sf).select("device", "ts", "event_id", "voltage")
    P.write_partitioned(df, str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == df.count()
    plan = back.filter("date = '2024-01-05' AND device = 'bms1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(device,bms1)" in plan


def test_changed_only_can_be_filled_back(spark, sf):
    df = samples(spark, sf).select("device", "ts", "event_id", F.floor(F.col("soc") / 40).alias("a"), F.col("switches")["charge"].alias("b"))
    kept = W.changed_only(df, ("a", "b"))
    assert kept.count() < df.count()
    sparse = df.select("device", "ts", "event_id").join(kept.select("event_id", "a", "b"), "event_id", "left")
    full = sparse.selectExpr("event_id", *[f"last({c}, true) over (partition by device order by ts, event_id) {c}" for c in "ab"])
    assert full.exceptAll(df.select("event_id", "a", "b")).isEmpty()


def test_encoding_is_smaller_or_equal_and_exact_to_half_a_step(spark, sf, tmp_path):
    flat = samples(spark, sf).select("device", "ts", "event_id", "voltage", "current", "soc", "mos_temperature")
    enc = P.encode_fixed_point(flat, ("device", "ts", "event_id"))
    assert dict(enc.dtypes)["voltage"] == "int"
    back = P.decode_fixed_point(enc).alias("d").join(flat.alias("f"), "event_id")
    for c, scale in (("voltage", 1000), ("current", 1000), ("soc", 100), ("mos_temperature", 100)):
        assert back.agg(F.max(F.abs(F.col(f"d.{c}") - F.col(f"f.{c}")))).first()[0] <= 0.5 / scale + 1e-9


def test_refresh_is_reproducible(spark, sf):
    df = samples(spark, sf).select("device", "ts", "event_id")
    a = df.filter(W.periodic_refresh(20)).count()
    assert a == df.filter(W.periodic_refresh(20)).count() and 0 < a < df.count() / 5
