"""Batteries in parallel: align the members on a common clock, then add them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatt.operators.prefix import scan
from fleetwatt.operators.timeline import DEVICE_TIME, Timeline


#: ticks of a gap that one row gives at once
TICKS_AT_ONCE = 4096


def align_group(samples: DataFrame, members: DataFrame, tick_s: int, tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Last known row of every member at each tick, from the first tick at which all members have reported.

    Samples are reduced to one row per member and tick before anything is ordered, and those are ordered in runs of equal
    size, whatever the length of a member's history.
    """
    tl = tl.of(samples)
    us = tick_s * 1_000_000
    rest = [c for c in samples.columns if c not in tl.keys]
    rows = samples.withColumnRenamed("device", "member").join(members, "member")
    at_tick = rows.withColumn("__tick", F.ceil(F.unix_micros(tl.time) / us).cast("long"))
    last = at_tick.groupBy("group", "member", "ord", "__tick").agg(
        F.max_by(F.struct(*rest), tl.order_key()).alias("row")
    )
    # the bounds come from the keys and the time alone, so the wide rows are aggregated once
    per_member = at_tick.groupBy("group", "member").agg(F.min("__tick").alias("lo"), F.max("__tick").alias("hi"))
    sizes = members.groupBy("group").agg(F.countDistinct("member").alias("n_members"))
    span = (
        per_member.groupBy("group").agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("seen"))
        .join(sizes, "group").filter("seen = n_members").select("group", "lo", "hi")
    )
    # the next tick is the one before on a clock that runs backwards
    back = Timeline(("group", "member"), "__back", ("__back",))
    turned = last.withColumn("__back", F.timestamp_micros(-F.col("__tick") * us))
    held = scan(turned, back, lag={"__next": F.col("__tick")}).drop("__back").join(span, "group")
    first = F.greatest("__tick", "lo")
    until = F.coalesce(F.col("__next") - 1, F.col("hi"))
    # a long gap is cut in stretches first, so that no row ever holds more than one stretch of ticks
    part = lambda c: F.floor(F.col(c) / TICKS_AT_ONCE).cast("long")
    lo, hi = F.col("__part") * TICKS_AT_ONCE, (F.col("__part") + 1) * TICKS_AT_ONCE - 1
    return (
        held.withColumn("__from", first).withColumn("__to", until).filter("__from <= __to")
        .withColumn("__part", F.explode(F.sequence(part("__from"), part("__to"))))
        .select("group", "member", "ord", "__from", "__to", "__part", "row.*")
        .select("group", "member", "ord", F.explode(F.sequence(F.greatest("__from", lo), F.least("__to", hi))).alias("__t"), *rest)
        .select("group", "member", "ord", (F.col("__t") * tick_s).alias("tick"), *rest)
    )


def _strict_sum(c: Column | str) -> Column:
    """A member without the value makes the total unknown."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def _strict_avg(c: str) -> Column:
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def _in_order(c: str) -> Column:
    """Member arrays one after the other, in member order (a group has few members)."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", F.col(c).alias("v"))))
    return F.flatten(F.transform(ordered, lambda x: x["v"]))


def _merged(c: str) -> Column:
    """Union of the members' maps in member order; the later member wins."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", F.map_entries(c).alias("e"))))
    known = F.filter(ordered, lambda x: x["e"].isNotNull())
    entries = F.reverse(F.flatten(F.transform(known, lambda x: x["e"])))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    # the first entry from the end is the one that counts
    value = lambda k: F.get(F.filter(entries, lambda e: e["key"] == k), F.lit(0))["value"]
    return F.map_from_arrays(names, F.transform(names, value))


def sum_parallel(aligned: DataFrame, keys=("group", "tick"), time: str = "ts") -> DataFrame:
    """The group's sample: mean voltage, summed currents and charges, capacity-weighted soc and soh."""
    cap = F.col("capacity")
    have = set(aligned.columns)
    aggs = [F.avg("voltage").alias("voltage"), F.count(F.lit(1)).alias("n_members"), F.min(time).alias(time)]
    for c in ("current", "power", "charge", "capacity", "aged_capacity", "total_charge_throughput"):
        if c in have:
            aggs.append(_strict_sum(c).alias(c))
    if "num_cycles" in have:
        aggs.append(_strict_avg("num_cycles").alias("num_cycles"))
    for c in ("soc", "soh"):
        if c in have:
            total = _strict_sum("capacity")
            aggs.append(F.when(total != 0, _strict_sum(F.col(c) * cap) / total).alias(c))
    if "mos_temperature" in have:
        aggs.append(F.max("mos_temperature").alias("mos_temperature"))
    if "temperatures" in have:
        empty = F.array().cast("array<double>")
        aligned = aligned.withColumn("temperatures", F.coalesce("temperatures", empty))
        aggs.append(_in_order("temperatures").alias("temperatures"))
    if "cell_mv" in have:
        complete = F.count("cell_mv") == F.count(F.lit(1))
        aggs.append(F.when(complete, _in_order("cell_mv")).alias("cell_mv"))
    if "switches" in have:
        aggs.append(_merged("switches").alias("switches"))
    return aligned.groupBy(*keys).agg(*aggs)


def merge_switches(aligned: DataFrame, keys=("group", "tick")) -> DataFrame:
    return aligned.groupBy(*keys).agg(_merged("switches").alias("switches"))


def group_samples(samples: DataFrame, members: DataFrame, tick_s: int, tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Group rows in the layout of device rows, ready for `unionByName` with them."""
    return sum_parallel(align_group(samples, members, tick_s, tl), time=tl.time).withColumnRenamed("group", "device")
