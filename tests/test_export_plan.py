"""The export: devices are looked up for the rows that the throttle keeps, so no task gets all rows of a device."""

import datetime

from fleetwatt.sinks import points as P


def test_devices_are_joined_after_the_throttle(spark):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(d, t0 + datetime.timedelta(seconds=i), i, 50.0 + i % 3) for d in ("a", "b", "c") for i in range(100)]
    flat = spark.createDataFrame(rows, "device string, ts timestamp, event_id bigint, voltage double")
    devices = spark.createDataFrame([("a", "A0", "jbd", False), ("b", "B0", "dummy", False)], "device string, address string, type string, is_virtual boolean")
    out = P.export_anonymized(flat, devices, "u1", 30.0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join Inner") < plan.index("MapInArrow")
    assert sorted((r["slug"], r["event_id"], r["voltage"]) for r in out.collect()) == [("jbd", i, 50000 + i % 3 * 1000) for i in (0, 30, 60, 90)]
