"""Energy, charge and cycle meters: trapezoids and absolute differences between neighbouring samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatt.operators.prefix import RUN, in_runs, released, scan
from fleetwatt.operators.timeline import DEVICE_TIME, Timeline, has_hot_slice, micros
from fleetwatt.operators.timeline import scan as reaching_scan

METERS = (
    "total_charge",
    "total_energy",
    "total_energy_discharge",
    "total_energy_charge",
    "total_cycles",
    "total_abs_diff_charge",
)

#: fixed values: limits of the absolute-difference meters
DIFF_GAP_S = 3600.0
CYCLE_STEP_MAX = 0.1
CHARGE_STEP_MAX = 0.5


def _hours(prev: Column, time: str) -> Column:
    return (micros(time) - prev["t"]) / F.lit(3.6e9)


def trapezoid(prev: Column, y: Column, gap_s: float, time: str = "ts") -> Column:
    """Area since the previous known sample `prev` (t, y); gaps above `gap_s` add nothing."""
    dx = _hours(prev, time)
    return F.when(dx <= gap_s / 3600.0, dx * (prev["y"] + y) / 2)


def abs_step(prev: Column, y: Column, gap_s: float, step_max: float, time: str = "ts") -> Column:
    dy = F.abs(y - prev["y"])
    return F.when((_hours(prev, time) <= gap_s / 3600.0) & (dy <= step_max), dy)


def integrate(df: DataFrame, y: Column, gap_s: float, out: str, tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Running trapezoid of one signal; rows without a value are skipped over."""
    given, df = df, in_runs(df, tl).withColumn("__y", y)
    df = scan(df, tl, last_before={"__p": F.when(F.col("__y").isNotNull(), F.struct(micros(tl.time).alias("t"), F.col("__y").alias("y")))})
    df = df.withColumn("__inc", F.coalesce(trapezoid(F.col("__p"), F.col("__y"), gap_s, tl.time), F.lit(0.0)))
    return released(scan(df, tl, total={out: F.col("__inc")}).drop("__y", "__p", "__inc"), given)


def abs_diff_sum(df: DataFrame, y: Column, gap_s: float, step_max: float, out: str, tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Running sum of absolute steps; a missing value breaks the chain on both sides."""
    given, df = df, in_runs(df, tl).withColumn("__y", y)
    df = scan(df, tl, lag={"__p": F.struct(micros(tl.time).alias("t"), F.col("__y").alias("y"))})
    df = df.withColumn("__inc", F.coalesce(abs_step(F.col("__p"), F.col("__y"), gap_s, step_max, tl.time), F.lit(0.0)))
    return released(scan(df, tl, total={out: F.col("__inc")}).drop("__y", "__p", "__inc"), given)


def meter_increments(
    df: DataFrame,
    gap_s: float,
    invert: Column | bool = False,
    tl: Timeline = DEVICE_TIME,
) -> DataFrame:
    """One row per sample with its contribution to each of the six meters.

    `current` and `power` are calibrated and positive for discharge. The directional meters read them
    as they are; the net meters read them after the optional inversion of published values.
    """
    sign = F.when(invert if isinstance(invert, Column) else F.lit(invert), F.lit(-1.0)).otherwise(F.lit(1.0))
    t = micros(tl.time)
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(t.alias("t"), F.col(c).alias("y")))
    df = df.withColumn("__sign", sign)
    before = {"__i": known("current"), "__p": known("power")}
    lag = {
        "__soc": F.struct(t.alias("t"), (F.col("soc") * 0.005).alias("y")),
        "__q": F.struct(t.alias("t"), F.col("charge").cast("double").alias("y")),
    }
    # a table in runs is scanned as it is, and one with a slice too large for a task is brought in runs; any other is scanned in slices that
    # get copies of what is within reach, without a second pass
    if RUN in df.columns or (tl.hot is None and has_hot_slice(df, tl)):
        df = scan(df, tl, last_before=before, lag=lag)
    else:
        df = reaching_scan(df, tl, last_before=before, lag=lag, reach_s=max(gap_s, DIFF_GAP_S))

    def directional(f) -> Column:
        prev = F.struct(F.col("__p")["t"].alias("t"), (f(F.col("__p")["y"]) * 1e-3).alias("y"))
        return trapezoid(prev, f(F.col("power")) * 1e-3, gap_s, tl.time)

    inc = {
        "total_charge": F.col("__sign") * trapezoid(F.col("__i"), F.col("current"), gap_s, tl.time),
        "total_energy": F.col("__sign") * directional(lambda p: p),
        "total_energy_discharge": directional(lambda p: F.greatest(p, F.when(p.isNotNull(), F.lit(0.0)))),
        "total_energy_charge": directional(lambda p: F.abs(F.least(p, F.when(p.isNotNull(), F.lit(0.0))))),
        "total_cycles": abs_step(F.col("__soc"), F.col("soc") * 0.005, DIFF_GAP_S, CYCLE_STEP_MAX, tl.time),
        "total_abs_diff_charge": abs_step(
            F.col("__q"), F.col("charge").cast("double"), DIFF_GAP_S, CHARGE_STEP_MAX, tl.time
        ),
    }
    return df.select("*", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in inc.items()]).drop(
        "__i", "__p", "__soc", "__q", "__sign"
    )


def meter_totals(increments: DataFrame, keys: tuple[str, ...] = ("device",)) -> DataFrame:
    return increments.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in METERS], F.count(F.lit(1)).alias("samples"))


def meter_readings(increments: DataFrame, tl: Timeline = DEVICE_TIME, before: Sequence[str] = ()) -> DataFrame:
    """Running readings, one per sample; also, as <column>_before, readings and other columns of the row before."""
    inc = increments.select("*", *[F.col(m).alias(f"__{m}") for m in METERS]).drop(*METERS)
    totals = {f"{m}_before": F.col(f"__{m}") for m in METERS if m in before}
    others = {f"{c}_before": F.col(c) for c in before if c not in METERS}
    return scan(inc, tl, total={m: F.col(f"__{m}") for m in METERS}, total_before=totals, lag=others).drop(*[f"__{m}" for m in METERS])


def restore_meters(totals_long: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Add the stored reading of each (device, meter); meters without one start at zero.

    `totals_long` is (device, meter, increment). The interval across the restart is not integrated,
    which is what an increment table that starts after the snapshot already says.
    """
    return totals_long.join(snapshot.select("device", "meter", "reading"), ["device", "meter"], "left").select(
        "device", "meter", (F.coalesce("reading", F.lit(0.0)) + F.col("increment")).alias("reading")
    )


def meters_long(totals: DataFrame, value: str = "increment") -> DataFrame:
    return totals.unpivot(["device"], list(METERS), "meter", value)


def reconcile_energy(totals: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Net energy must equal discharge minus charge."""
    diff = F.col("total_energy") - (F.col("total_energy_discharge") - F.col("total_energy_charge"))
    return totals.withColumn("energy_balance", diff).withColumn("balanced", F.abs(diff) < eps)


def utility_meter(df: DataFrame, reading: Column, cycle: str = "day", tl: Timeline = DEVICE_TIME, previous: Column | None = None) -> DataFrame:
    """Consumption per cycle of an increasing reading; a reading that falls is a reset and adds nothing.

    `previous` is the reading of the row before, where the rows already have it; otherwise a scan brings it.
    """
    df = scan(df.withColumn("__r", reading), tl, lag={"__prev": F.col("__r")}) if previous is None else df.withColumns({"__r": reading, "__prev": previous})
    return (
        df.withColumn("__use", F.greatest(F.col("__r") - F.col("__prev"), F.lit(0.0)))
        .groupBy(*tl.keys, F.date_trunc(cycle, F.col(tl.time)).alias("cycle_start"))
        .agg(F.coalesce(F.sum("__use"), F.lit(0.0)).alias("consumption"))
    )
