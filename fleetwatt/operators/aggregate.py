"""Bucketed and grouped roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatt.operators.prefix import scan
from fleetwatt.operators.timeline import DEVICE_TIME, Timeline


def bucket_start(period_s: int, time: str = "ts") -> Column:
    """Start of the bucket as seconds since the epoch."""
    us = F.unix_micros(time)
    return ((us - F.pmod(us, F.lit(period_s * 1_000_000))) / 1_000_000).cast("long")


def downsample(df: DataFrame, period_s: int, tl: Timeline = DEVICE_TIME, explicit_power: str = "power") -> DataFrame:
    """Per device and period: mean voltage and current, everything else from the last sample.

    The power is the mean over the period where the last sample reports one itself, else the product
    of the two means.
    """
    tl = tl.of(df)
    rest = [c for c in df.columns if c not in (*tl.keys, "voltage", "current", explicit_power)]
    agg = (
        df.withColumn("__bucket", bucket_start(period_s, tl.time))
        .groupBy(*tl.keys, "__bucket")
        .agg(
            F.avg("voltage").alias("voltage"),
            F.avg("current").alias("current"),
            F.avg(F.coalesce(explicit_power, F.col("voltage") * F.col("current"))).alias("__power"),
            F.max_by(F.struct(F.col(explicit_power).alias("__explicit"), *rest), tl.order_key()).alias("__last"),
            F.count(F.lit(1)).alias("n_samples"),
        )
    )
    p = F.when(F.col("__last.__explicit").isNotNull(), F.col("__power")).otherwise(F.col("voltage") * F.col("current"))
    return agg.select(
        *tl.keys, F.col("__bucket").alias("bucket"), "voltage", "current", p.alias("power"), "n_samples",
        *[F.col(f"__last.{c}").alias(c) for c in rest],
    )


def bucket_mean(
    df: DataFrame,
    value: Column,
    interval_s: int,
    t0_s: int,
    t1_s: int,
    entity: str | None = None,
    entities: Sequence[str] | None = None,
    time: str = "ts",
) -> DataFrame:
    """Mean per interval over [t0, t1), with a row for every interval and NULL where nothing was seen.

    With `entity` and `entities` each of the named entities gets its own series; otherwise all
    rows make one series.
    """
    spark = df.sparkSession
    t = F.unix_micros(F.col(time))
    rows = df.filter((t >= t0_s * 1_000_000) & (t < t1_s * 1_000_000)).withColumn("bucket", bucket_start(interval_s, time))
    keys = ["bucket"]
    first = t0_s // interval_s
    n = max(0, -(-t1_s // interval_s) - first)
    grid = spark.range(n).select(((F.col("id") + first) * interval_s).alias("bucket"))
    if entity is not None:
        keys = [entity, "bucket"]
        rows = rows.filter(F.col(entity).isin(*entities))
        grid = grid.select(F.explode(F.array(*[F.lit(e) for e in entities])).alias(entity), "bucket")
    means = rows.groupBy(*keys).agg(F.avg(value).alias("mean_value"))
    return grid.join(means, keys, "left")


def learned_cell_count(df: DataFrame, cells: str = "cell_mv", tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Trim padding zeros behind the highest cell position ever seen populated; a dead cell before it stays."""
    at = F.transform(F.col(cells), lambda v, i: F.when(v != 0, i + 1))
    df = df.withColumn("__populated", F.coalesce(F.array_max(at), F.lit(0)))
    df = scan(df, tl, high={"cell_count": F.col("__populated")})
    return df.withColumn(cells, F.slice(F.col(cells), F.lit(1), F.col("cell_count"))).drop("__populated")


def sample_count(df: DataFrame, out: str = "num_samples", tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Running number of the sample per device, from zero."""
    return scan(df, tl, total={"__n": F.lit(1).cast("long")}).withColumn(out, F.col("__n") - 1).drop("__n")


def latest_values(
    df: DataFrame, at_us: Column | int, expire_s: float, keys: Sequence[str] = ("device", "entity"), time: str = "ts", order=("ts",)
) -> DataFrame:
    """Last value of each entity at an instant, and whether it is too old to be shown."""
    t = F.unix_micros(F.col(time))
    at = at_us if isinstance(at_us, Column) else F.lit(at_us)
    last = df.filter(t <= at).groupBy(*keys).agg(
        F.max_by(F.struct("value", t.alias("t")), F.struct(*order)).alias("last")
    )
    return last.select(
        *keys,
        F.col("last.value").alias("value"),
        F.col("last.t").alias("seen_us"),
        (at - F.col("last.t") <= int(expire_s * 1e6)).alias("available"),
    )


#: fixed value: meters stay shown for at least this long
METER_EXPIRY_S = 7200.0
