"""Operators on the canonical schema, and rows that once were lost or stopped a job."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from fleetwatt.functions.frames import LAYOUTS, decode
from fleetwatt.functions.scalar import reject_reason, roles_by_position
from fleetwatt.operators import aggregate, folds, meters, windows
from fleetwatt.operators.timeline import DEVICE_TIME
from fleetwatt.schema import SAMPLES
from fleetwatt.sinks import points as P
from fleetwatt.sources.readers import read_samples
from fleetwatt.streaming import folds as S


def canonical(spark, n=40):
    t0 = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        r = {f.name: None for f in SAMPLES}
        r |= {"device": f"d{i % 2}", "ts": t0 + datetime.timedelta(minutes=i), "voltage": 50.0, "current": float(i % 5), "soc": 50.0 + i, "charge": 10.0, "cell_mv": [3300 + i, 3310]}
        rows.append(tuple(r[f.name] for f in SAMPLES))
    return spark.createDataFrame(rows, SAMPLES)


def test_operators_run_on_canonical_samples(spark, tmp_path):
    path = str(tmp_path / "samples")
    canonical(spark).write.parquet(path)
    samples = read_samples(spark, path).withColumn("power", F.coalesce("power", F.col("voltage") * F.col("current")))
    totals = {r["device"]: r for r in meters.meter_totals(meters.meter_increments(samples, gap_s=600)).collect()}
    assert set(totals) == {"d0", "d1"} and totals["d0"]["total_energy"] > 0
    assert windows.weakest_cell(samples).count() == 40
    assert folds.ewma(samples, F.col("current"), 10).count() == 40
    assert aggregate.downsample(samples, 600).count() == 8
    assert P.changed_points(samples, ("voltage", "current")).count() > 0


def test_slices_before_1970(spark):
    df = spark.sql("select 'a' device, timestamp_micros(x) ts from values (-1L), (0L), (-86400000000L), (-86400000001L) t(x)")
    assert [r[0] for r in df.select(DEVICE_TIME.slice_of()).collect()] == [-86400000000, 0, -86400000000, -172800000000]
    assert [r[0] for r in df.select(aggregate.bucket_start(600)).collect()] == [-600, 0, -86400, -87000]


def test_as_many_values_as_the_frame_declares(spark):
    layout = LAYOUTS["daly2"]
    frame = bytearray(3 + 124)
    frame[3 + 100 : 3 + 102] = (10).to_bytes(2, "big")
    for i in range(10):
        frame[3 + 64 + 2 * i : 3 + 66 + 2 * i] = (60 + i).to_bytes(2, "big")
    got = spark.createDataFrame([(frame,)], "frame binary").select(decode(F.col("frame"), layout)["temperatures"].alias("t")).first()["t"]
    assert len(got) == 10 and got[:8] == [20 + i for i in range(8)]


def test_large_packs_are_not_rejected(spark):
    df = spark.createDataFrame([(50.0, [3300] * 48, 20.0), (50.0, [], 20.0)], "soc double, cell_mv array<int>, mos_temperature double")
    assert [r[0] for r in df.select(reject_reason()).collect()] == [None, "cell_count"]
    assert [r[0] for r in df.select(reject_reason(max_cells=16)).collect()] == ["cell_count", "cell_count"]


def test_all_sensors_keep_a_role(spark):
    t = spark.createDataFrame([([float(i) for i in range(11)],)], "t array<double>").select(roles_by_position("t").alias("p")).select("p.*").first()
    assert len(t["temperatures"]) == 10 and t["mos_temperature"] == 4.0


def layouts(spark):
    t0 = datetime.datetime(2024, 1, 1)
    packs = [[3300, 3301], [None, 3301, 3302], [3300, 3301], [3300, 3301]]
    rows = [("a", t0 + datetime.timedelta(hours=20 * i), i, p) for i, p in enumerate(packs)]
    return spark.createDataFrame(rows, "device string, ts timestamp, event_id bigint, cell_mv array<int>")


def test_cells_again_after_a_layout_change(spark):
    wide = P.cell_points(layouts(spark), 3).orderBy("ts").collect()
    assert [(r["voltage_cell000"], r["voltage_cell001"], r["voltage_cell002"]) for r in wide] == [(3300, 3301, None), (None, 3301, 3302), (3300, 3301, None), (None, None, None)]
    long = P.changed_cells(layouts(spark), ("event_id",)).collect()
    assert sorted(tuple(r) for r in long) == [(0, 0, 3300), (0, 1, 3301), (1, 1, 3301), (1, 2, 3302), (2, 0, 3300), (2, 1, 3301)]


def test_a_spike_does_not_stop_the_export(spark):
    df = spark.createDataFrame([("a", 1e9, [3300] * 34), ("a", 50.0, [1])], "device string, voltage double, cell_mv array<int>")
    got = P.encode_fixed_point(df, ("device",)).collect()
    assert [r["voltage"] for r in got] == [None, 50000] and [r["cells_left_out"] for r in got] == [2, 0]


def test_stream_cells_of_arrays_and_bytes():
    import json

    row = [S._plain(v) for v in (np.array([1.0, float("nan")]), b"\x01\xff", float("nan"), np.int64(3), None)]
    assert row == [[1.0, None], b"\x01\xff", None, 3, None]
    assert json.loads(json.dumps(row, default=S._bytes_out), object_hook=S._bytes_back) == row


def test_shared_folder_must_be_named_off_local_mode():
    import pytest

    from fleetwatt.session import shared_folder

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(Session())
