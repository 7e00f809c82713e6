"""Cells compared with what a pack's own cells had before, carried along runs: against a plain loop, in many and in few runs."""

import datetime
import random

from pyspark.sql import functions as F

from fleetwatt.operators import prefix
from fleetwatt.sinks import points as P


def packs(kind):
    rnd, out = random.Random(11), []
    t0 = datetime.datetime(2024, 1, 1)
    for i in range(600):
        d = rnd.choice("aaaab")
        n = rnd.choice([3] * 30 + [5, 0, None])
        cells = None if n is None else [rnd.choice([None, kind(1), kind(2)]) for _ in range(n)]
        out.append((d, t0 + datetime.timedelta(seconds=i), i, cells, i % 50 == 7))
    return out


def plain(rows):
    last, size, out = {}, {}, []
    for d, _, i, cells, whole in rows:
        n = None if cells is None else len(cells)
        if n is not None and size.get(d) is not None and size[d] != n:
            last[d] = {}
        size[d] = n
        for j, v in enumerate(cells or []):
            if v is not None and (whole or last.setdefault(d, {}).get(j) != v):
                out.append((i, j, v))
            if v is not None:
                last.setdefault(d, {})[j] = v
    return sorted(out)


def changed(df):
    return sorted(tuple(r) for r in P.changed_cells(df, ("event_id",), F.col("whole")).collect())


def test_cells_against_a_loop(spark):
    for kind, name in ((int, "int"), (float, "double")):
        rows = packs(kind)
        df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), f"device string, ts timestamp, event_id bigint, cell_mv array<{name}>, whole boolean").repartition(5)
        for runs in (1, 4, 23):
            assert changed(prefix.in_runs(df, runs=runs)) == plain(rows)


def test_batches_smaller_than_runs(spark):
    rows = packs(int)
    df = spark.createDataFrame(rows, "device string, ts timestamp, event_id bigint, cell_mv array<int>, whole boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert changed(prefix.in_runs(df, runs=3)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_cells_are_not_sorted_one_by_one(spark):
    """The only rows that are shuffled by their order are samples."""
    df = spark.createDataFrame(packs(int), "device string, ts timestamp, event_id bigint, cell_mv array<int>, whole boolean")
    plan = P.changed_cells(df, ("event_id",))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate posexplode") < plan.index("MapInArrow")
