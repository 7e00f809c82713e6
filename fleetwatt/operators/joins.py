"""Joins of samples with devices, ambient channels, slow side readings, signatures and groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatt.functions.scalar import calibrate
from fleetwatt.operators import prefix
from fleetwatt.operators.timeline import DEVICE_TIME, Timeline, has_hot_slice, micros, scan


def with_device(samples: DataFrame, devices: DataFrame) -> DataFrame:
    """Attach configuration; a device that is not configured keeps its own name and a calibration of 1.

    No broadcast hint: Spark broadcasts the device table while its measured size is under the
    session's threshold and shuffles it when a fleet outgrows that.
    """
    return (
        samples.join(devices, "device", "left")
        .withColumn("current_calibration", F.coalesce("current_calibration", F.lit(1.0)))
        .withColumn("address", F.coalesce("address", "device"))
    )


def resolve_addresses(entries: DataFrame, discovered: DataFrame) -> DataFrame:
    """Configured names -> discovered addresses, keeping the given text when nothing matches."""
    names = discovered.groupBy(F.trim("name").alias("__name")).agg(F.min("address").alias("__found"))
    return (
        entries.join(names, F.trim("address") == F.col("__name"), "left")
        .withColumn("address", F.coalesce("__found", "address"))
        .drop("__name", "__found")
    )


def calibrated(samples: DataFrame, factor: str = "current_calibration", explicit_power: str | None = "power") -> DataFrame:
    out = {"current": calibrate("current", F.col(factor))}
    if explicit_power:
        out[explicit_power] = calibrate(explicit_power, F.col(factor))
    return samples.withColumns(out)


def asof(
    left: DataFrame,
    right: DataFrame,
    values: Mapping[str, Column],
    max_age_s: float | None = None,
    keys: Sequence[str] = ("device",),
    tl: Timeline = DEVICE_TIME,
) -> DataFrame:
    """Latest known value of each column in `values` (expressions over `right`) at each left row.

    Each value column is carried on its own, so a right row that lacks one does not hide an older
    value. Both sides go through one scan: no row meets more than its own neighbours. With an age limit that is a scan in slices, to which
    right rows are copied as far as they are valid. Without one, when the right side has no device key (`keys=()`), or when a slice is too large for a task, it is a
    scan over range partitions: nothing is copied, and what stands before a partition comes in its head.
    """
    tl = tl.of(left)
    side = Timeline(tuple(keys), tl.time, (tl.time, "__side", *[c for c in tl.order if c != tl.time]), tl.width_s, tl.hot if tuple(keys) == tuple(tl.keys) else None)
    probe = left.withColumn("__side", F.lit(1))
    source = right.select(
        *keys, F.col(tl.time), F.lit(0).alias("__side"),
        *[c for c in tl.order if c != tl.time and c in right.columns],
        *[F.when(e.isNotNull(), F.struct(micros(tl.time).alias("t"), e.alias("v"))).alias(f"__r_{n}") for n, e in values.items()],
    )
    rows = probe.unionByName(source, allowMissingColumns=True)
    last = {f"__k_{n}": F.col(f"__r_{n}") for n in values}
    if max_age_s is None or not keys or (side.hot is None and has_hot_slice(rows, side)):
        rows = prefix.scan(rows, side, last=last)
    else:
        rows = scan(rows, side, last=last, reach_s=max_age_s, reach_if=F.col("__side") == 0)
    rows = rows.filter("__side = 1")
    out = {}
    for n in values:
        age_ok = F.lit(True) if max_age_s is None else micros(tl.time) - F.col(f"__k_{n}")["t"] <= int(max_age_s * 1e6)
        out[n] = F.when(age_ok, F.col(f"__k_{n}")["v"])
    drop = ["__side"] + [f"__r_{n}" for n in values] + [f"__k_{n}" for n in values]
    return rows.withColumns(out).drop(*drop)


#: fixed value: an ambient reading older than this is missing
AMBIENT_MAX_AGE_S = 600.0


def asof_ambient(
    samples: DataFrame,
    ambient: DataFrame,
    channels: Sequence[str] = ("room", "outdoor"),
    max_age_s: float = AMBIENT_MAX_AGE_S,
    tl: Timeline = DEVICE_TIME,
) -> DataFrame:
    """Room and outdoor values at sample time from ambient(channel, ts, value), which has no device key."""
    values = {c: F.when(F.col("channel") == c, F.col("value")) for c in channels}
    return asof(samples, ambient, values, max_age_s, keys=(), tl=tl)


def asof_context(status: DataFrame, settings: DataFrame, columns: Sequence[str], tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Status rows with the latest settings; a status row before any settings stays, with NULLs."""
    return asof(status, settings, {c: F.col(c) for c in columns}, None, tl=tl)


#: fixed value: side readings are reused for this long
SLOW_TTL_S = 30.0


def fill_slow_fields(
    samples: DataFrame, slow: DataFrame, columns: Sequence[str], ttl_s: float = SLOW_TTL_S, tl: Timeline = DEVICE_TIME
) -> DataFrame:
    """Fields polled on their own fill in where the sample has none, up to `ttl_s` old."""
    known = asof(samples, slow, {f"__slow_{c}": F.col(c) for c in columns}, ttl_s, tl=tl)
    filled = {c: F.coalesce(F.col(c), F.col(f"__slow_{c}")) if c in samples.columns else F.col(f"__slow_{c}") for c in columns}
    return known.withColumns(filled).drop(*[f"__slow_{c}" for c in columns])


def membership_errors(members: DataFrame, devices: DataFrame) -> DataFrame:
    """Unknown members, members of two groups, and duplicate device names."""
    names = devices.select(F.col("device").alias("member")).distinct()
    unknown = members.join(names, "member", "left_anti").select(
        F.lit("unknown_member").alias("error"), F.col("member").alias("name"), F.col("group").alias("detail")
    )
    twice = (
        members.groupBy("member").agg(F.countDistinct("group").alias("n"), F.min("group").alias("first"))
        .filter("n > 1").select(F.lit("multiple_groups").alias("error"), F.col("member").alias("name"), F.col("first").alias("detail"))
    )
    dup = (
        devices.groupBy("device").count().filter("count > 1")
        .select(F.lit("duplicate_name").alias("error"), F.col("device").alias("name"), F.col("count").cast("string").alias("detail"))
    )
    return unknown.unionByName(twice).unionByName(dup)


def expand_group_commands(commands: DataFrame, members: DataFrame) -> DataFrame:
    """A command to a group becomes one command per member."""
    m = members.select(F.col("group").alias("device"), "member")
    return commands.join(m, "device", "left").withColumn("target", F.coalesce("member", "device")).drop("member")


#: fixed values: response signatures as (family, first bytes, last byte or None)
SIGNATURES = (
    ("braunpwr", "7b", 0x7D),
    ("jbd / supervolt", "dd", 0x77),
    ("jk", "55aaeb", None),
    ("daly", "a501", None),
    ("neey", "aa5511", None),
    ("cbtpwr", "aa55", 0x0D),
    ("tdt / seplos_v2 / cbtpwr_vb", "7e", 0x0D),
    ("ant_leg", "aa55aa", None),
)


def classify_protocol(frames: DataFrame, frame: str = "frame", signatures=SIGNATURES) -> DataFrame:
    """One row per frame and matching family. The signature list is a constant, so it is folded into
    the projection instead of joined."""
    f = F.col(frame)
    h = F.lower(F.hex(f))
    hits = []
    for family, head, tail in signatures:
        ok = (F.length(f) >= 4) & h.startswith(head)
        if tail is not None:
            ok = ok & h.endswith(f"{tail:02x}")
        hits.append(F.when(ok, F.lit(family)))
    return frames.withColumn("family", F.explode(F.array_compact(F.array(*hits))))
