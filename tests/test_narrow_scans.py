"""Scans pass whole rows through Python: queries on meters give them the columns that are read, and no more."""

import pytest

from fleetwatt.plans import load_all


@pytest.mark.parametrize("name", ["meter_readings", "meter_points", "daily_utility_meter"])
def test_meters_scan_what_they_read(spark, sf, name):
    plan = load_all()[0][name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "MapInArrow" in line or "map(" in line]
    assert scans and not any(c in line for line in scans for c in ("cell_mv", "switches", "ingest_ts"))
