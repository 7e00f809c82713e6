"""Ordered operators that are running columns over range partitions (`prefix`); those in a row share one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatt.operators.prefix import in_runs, released, scan
from fleetwatt.operators.timeline import DEVICE_TIME, Timeline, micros

#: fixed values: power jump detection
JUMP_REGULARISATION_W = 120.0
JUMP_THRESHOLD = 0.15
JUMP_HOLD_S = 4.0


def power_jump(
    df: DataFrame,
    power: str = "power",
    reg: float = JUMP_REGULARISATION_W,
    threshold: float = JUMP_THRESHOLD,
    hold_s: float = JUMP_HOLD_S,
    virtual: Column | None = None,
    tl: Timeline = DEVICE_TIME,
) -> DataFrame:
    """`jump` marks a relative power rise; `jump_hold` stays true for `hold_s` after one."""
    given, df = df, scan(in_runs(df, tl), tl, lag={"__prev": F.col(power)})
    prev = F.coalesce("__prev", F.lit(0.0))
    p = F.col(power)
    jump = (F.abs((p - prev) / (F.abs(prev) + reg)) > threshold) & (F.abs(p) > F.abs(prev))
    if virtual is not None:
        jump = jump & ~virtual
    df = df.withColumn("jump", F.coalesce(jump, F.lit(False))).drop("__prev")
    df = scan(df, tl, last={"__t_jump": F.when(F.col("jump"), micros(tl.time))})
    held = micros(tl.time) - F.col("__t_jump") < int(hold_s * 1e6)
    return released(df.withColumn("jump_hold", F.coalesce(held, F.lit(False))).drop("__t_jump"), given)


def changed_only(
    df: DataFrame, fields: Sequence[str], refresh: Column | None = None, tl: Timeline = DEVICE_TIME
) -> DataFrame:
    """NULL out fields equal to the previous full record and drop rows that have nothing left.

    Rows where `refresh` holds stay whole. `periodic_refresh` gives a reproducible one.
    """
    df = scan(df, tl, lag={f"__prev_{c}": F.col(c) for c in fields})
    whole = F.coalesce(refresh, F.lit(False)) if refresh is not None else F.lit(False)
    kept = {c: F.when(whole | ~F.col(c).eqNullSafe(F.col(f"__prev_{c}")), F.col(c)) for c in fields}
    df = df.withColumns(kept).drop(*[f"__prev_{c}" for c in fields])
    return df.filter(F.coalesce(*[F.col(c).cast("string") for c in fields]).isNotNull())


def periodic_refresh(one_in: int = 200, keys: Sequence[str] = ("device", "ts")) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(one_in)) == 0


#: fixed value: the latch closes at least this far below the stop level
LATCH_MARGIN = 0.2


def soc_latch(
    df: DataFrame,
    stop: Column | float,
    start: Column | float,
    out: str = "charging",
    initial: bool | None = True,
    tl: Timeline = DEVICE_TIME,
) -> DataFrame:
    """Hysteresis: off at `stop`, on again at `start` (at most stop - 0.2)."""
    stop = stop if isinstance(stop, Column) else F.lit(float(stop))
    start = start if isinstance(start, Column) else F.lit(float(start))
    soc = F.col("soc")
    edge = F.when(soc >= stop, False).when(soc <= F.least(start, stop - LATCH_MARGIN), True)
    df = scan(df, tl, last={out: edge})
    return df if initial is None else df.withColumn(out, F.coalesce(out, F.lit(initial)))


#: fixed values: LiFePO4 cell limits in mV
CELL_VALID = (2000, 4500)
CELL_ALMOST_EMPTY = 2700
CELL_ALMOST_FULL = 3500

#: stands for "no weakest cell" among cell numbers
NO_CELL = -1


def weakest_cell(df: DataFrame, cells: str = "cell_mv", tl: Timeline = DEVICE_TIME) -> DataFrame:
    """The cell that is both the emptiest and the fullest ever seen when the pack nears a limit.

    Three scans of one shuffle: the levels ever seen before a row, then the cells of the rows that beat them (of equal levels the
    first counts), then the last verdict, where "no weakest cell" is a verdict too.
    """
    c = F.col(cells)
    lo, hi = F.array_min(c).cast("int"), F.array_max(c).cast("int")
    ok = (lo >= CELL_VALID[0]) & (hi <= CELL_VALID[1])
    rows = in_runs(df, tl).withColumns({"__lo": F.when(ok, lo), "__hi": F.when(ok, hi)})
    rows = scan(rows, tl, low_before={"__least": F.col("__lo")}, high_before={"__most": F.col("__hi")})
    at = lambda v: (F.array_position(c, F.col(v)) - 1).cast("int")
    rows = scan(
        rows, tl,
        last={
            "__emptiest": F.when(F.col("__lo") < F.coalesce("__least", F.lit(CELL_VALID[1] + 1)), at("__lo")),
            "__fullest": F.when(F.col("__hi") > F.coalesce("__most", F.lit(CELL_VALID[0] - 1)), at("__hi")),
        },
    )
    empty, full = F.when(at("__lo") == F.col("__fullest"), at("__lo")), F.when(at("__hi") == F.col("__emptiest"), at("__hi"))
    verdict = F.when(F.col("__lo") < CELL_ALMOST_EMPTY, empty).when(F.col("__hi") > CELL_ALMOST_FULL, full)
    near = (F.col("__lo") < CELL_ALMOST_EMPTY) | (F.col("__hi") > CELL_ALMOST_FULL)
    rows = scan(rows, tl, last={"__weakest": F.when(near, F.coalesce(verdict, F.lit(NO_CELL)))})
    out = rows.withColumn("weakest_cell", F.nullif("__weakest", F.lit(NO_CELL)))
    return released(out.drop("__lo", "__hi", "__least", "__most", "__emptiest", "__fullest", "__weakest"), df)


def segments(df: DataFrame, threshold_s: float, out: str = "segment", tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Number of the uninterrupted segment, from zero."""
    given, df = df, scan(in_runs(df, tl), tl, lag={"__prev": micros(tl.time)})
    joined = micros(tl.time) - F.col("__prev") <= int(threshold_s * 1e6)
    df = df.withColumn("__new", F.when(joined, F.lit(0)).otherwise(F.lit(1)).cast("long")).drop("__prev")
    return released(scan(df, tl, total={"__n": F.col("__new")}).withColumn(out, F.col("__n") - 1).drop("__new", "__n"), given)


def outages(df: DataFrame, threshold_s: float, tl: Timeline = DEVICE_TIME) -> DataFrame:
    """One row per interruption: when it ended and how long it took."""
    df = scan(df, tl, lag={"__prev": micros(tl.time)})
    gap = (micros(tl.time) - F.col("__prev")) / 1e6
    return df.withColumn("gap_s", gap).filter(F.col("gap_s") > threshold_s).select(
        *tl.keys, F.timestamp_micros("__prev").alias("lost_at"), F.col(tl.time).alias("back_at"), "gap_s"
    )


def outage_threshold(period_s: float) -> float:
    """A watchdog calls silence an outage after five minutes, or four periods if that is longer."""
    return max(300.0, 4 * period_s)


def resolve_direction(
    df: DataFrame, current: str, charging: str, discharging: str, out: str = "current", tl: Timeline = DEVICE_TIME
) -> DataFrame:
    """Sign from the direction flags, magnitude from the analog reading.

    Absent or contradictory flags keep the last known direction; before any is known the raw sign stands.
    """
    flag = F.when(F.col(charging) != F.col(discharging), F.col(charging))
    df = scan(df.withColumn("__raw", F.col(current)), tl, last={"__chg": flag})
    mag = F.abs("__raw")
    signed = F.when(F.col("__chg"), -mag).when(~F.col("__chg"), mag).otherwise(F.col("__raw"))
    return df.withColumn(out, signed).drop("__raw", "__chg")


def direction_without_memory(current: Column, charging: Column, discharging: Column) -> Column:
    """Flags decide where they differ; otherwise the raw positive-charge reading is negated."""
    mag = F.abs(current)
    return F.when(discharging & ~charging, mag).when(charging & ~discharging, -mag).otherwise(-current)
