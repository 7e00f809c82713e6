"""What leaves the engine: change-only points, cell points, the compact export, meters, entity states."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwatt.functions.scalar import cell_stats, hash_id, round_half_even, round_sig, topic_prefix
from fleetwatt.operators.aggregate import METER_EXPIRY_S
from fleetwatt.operators.folds import throttle
from fleetwatt.operators.prefix import RUN, in_runs, released, scan
from fleetwatt.operators.timeline import DEVICE_TIME, Timeline, micros
from fleetwatt.operators.windows import changed_only
from fleetwatt.schema import BOOL_FIELDS, ENTITIES, FLOAT_FIELDS, INT_SCALE, LONG_FIELDS, MAX_CELLS, METER_ENTITIES, METER_NAMES

def point_time_ms(time: str = "ts") -> Column:
    """Milliseconds, rounded up."""
    return F.ceil(micros(time) / 1000).cast("long")


def as_point_field(df: DataFrame, name: str) -> Column:
    """Numbers and flags as doubles with three decimals; infinities, NaN and empty strings are missing."""
    t, c = df.schema[name].dataType, F.col(name)
    if isinstance(t, T.BooleanType):
        return c.cast("double")
    if isinstance(t, T.StringType):
        return F.when(c != "", c)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        ok = ~F.isnan(c) & (F.abs(c) != float("inf"))
        return F.when(ok, round_half_even(c, 3))
    return c.cast("double")


def changed_points(df: DataFrame, fields: Sequence[str], refresh: Column | None = None, tl: Timeline = DEVICE_TIME) -> DataFrame:
    """Flat samples -> sparse points with only what changed."""
    df = df.withColumns({f: as_point_field(df, f) for f in fields})
    return changed_only(df, fields, refresh, tl).withColumn("time_ms", point_time_ms(tl.time))


def cell_points(
    df: DataFrame, n_cells: int, refresh: Column | None = None, truncate: bool = True, aggregates: bool = True, tl: Timeline = DEVICE_TIME
) -> DataFrame:
    """One row per sample: `voltage_cellNNN` of the first `n_cells` cells where the cell changed, plus pack statistics
    over all cells. `changed_cells` has every cell, one row each.

    Each cell is compared with its own last valid value since the pack last changed its number of cells.
    """
    cells = F.col("cell_mv")
    size = F.size(cells)
    now = [F.get(cells, F.lit(i)) for i in range(n_cells)]
    tl = tl.of(df)
    given, df = df, scan(in_runs(df, tl), tl, lag={"__size": size})
    changed = F.when(F.col("__size").isNotNull() & (F.col("__size") != size), tl.order_key())
    seen = {f"__c{i}": F.when(v.isNotNull(), F.struct(tl.order_key().alias("at"), v.alias("v"))) for i, v in enumerate(now)}
    df = scan(df, tl, last={"__since": changed}, last_before=seen)
    whole = F.coalesce(refresh, F.lit(False)) if refresh is not None else F.lit(False)
    as_int = (lambda c: c.cast("int")) if truncate else (lambda c: F.rint(c).cast("int"))
    out = {}
    for i, v in enumerate(now):
        old = F.col(f"__c{i}")
        same = old.isNotNull() & (F.col("__since").isNull() | (old["at"] >= F.col("__since"))) & (old["v"] == v)
        out[f"voltage_cell{i:03d}"] = F.when(v.isNotNull() & (whole | ~F.coalesce(same, F.lit(False))), as_int(v))
    if aggregates:
        known = F.filter(cells, lambda v: v.isNotNull())
        total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
        srt, n = F.array_sort(known), F.size(known)
        mid = F.floor(n / 2).cast("int")
        out["voltage_cell_max"] = as_int(F.array_max(known))
        out["voltage_cell_min"] = as_int(F.array_min(known))
        out["voltage_cell_mean"] = F.when(n > 0, total / n)
        out["voltage_cell_median"] = F.when(n % 2 == 1, F.get(srt, mid).cast("double")).otherwise((F.get(srt, mid - 1) + F.get(srt, mid)) / 2.0)
    return released(df.withColumns(out).drop(*seen, "__size", "__since"), given)


def changed_cells(df: DataFrame, keys: Sequence[str] = ("device", "ts"), refresh: Column | None = None, tl: Timeline = DEVICE_TIME) -> DataFrame:
    """(keys, cell_index, voltage): one row per changed cell, however many cells the pack has.

    Samples are ordered, not their cells: a run carries the last known values of a pack's cells along.
    """
    tl, size = tl.of(df), F.size("cell_mv")
    whole = F.coalesce(refresh, F.lit(False)) if refresh is not None else F.lit(False)
    df = df.select(*dict.fromkeys([*keys, *tl.keys, *tl.order, *[c for c in (RUN,) if c in df.columns]]), whole.alias("__whole"), "cell_mv")
    df = scan(in_runs(df, tl), tl, lag={"__size": size})
    reset = F.coalesce(F.col("__size") != size, F.lit(False))
    df = scan(df, tl, items_before={"__old": F.struct(reset.alias("reset"), F.col("cell_mv").alias("items"))})
    pairs = F.arrays_zip(F.col("cell_mv").alias("now"), F.col("__old.items").alias("old"))
    cells = df.select(*keys, "__whole", F.posexplode(pairs).alias("cell_index", "__cell"))
    now, old = F.col("__cell.now"), F.col("__cell.old")
    changed = now.isNotNull() & (F.col("__whole") | old.isNull() | (old != now))
    return cells.filter(changed).select(*keys, "cell_index", now.alias("voltage"))


def changed_cells_long(points: DataFrame, n_cells: int, keys: Sequence[str] = ("device", "ts")) -> DataFrame:
    """One row per changed cell."""
    cols = F.array(*[F.col(f"voltage_cell{i:03d}") for i in range(n_cells)])
    return points.select(*keys, F.posexplode(cols).alias("cell_index", "voltage")).filter("voltage IS NOT NULL")


def encode_fixed_point(flat: DataFrame, keep: Sequence[str] = ("device", "ts")) -> DataFrame:
    """Closed schema of scaled integers, flags and floats; every other column is dropped."""
    have = {f.name: f.dataType for f in flat.schema.fields}
    out = [F.col(k) for k in keep]
    finite = lambda c: F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")), c)
    for name, scale in INT_SCALE.items():
        if name in have and not isinstance(have[name], T.BooleanType):
            # a reading beyond the integer range is missing, not a reason to fail
            out.append(F.rint(finite(F.col(name)) * scale).try_cast("int").alias(name))
    for name in LONG_FIELDS:
        if name in have:
            out.append(F.col(name).cast("long").alias(name))
    for name in BOOL_FIELDS:
        if name in have:
            out.append(F.col(name).cast("boolean").alias(name))
    for name in FLOAT_FIELDS:
        if name in have:
            c = F.col(name).cast("double")
            out.append(round_half_even(finite(c), 3).cast("float").alias(name))
    if "cell_mv" in have:
        out += [F.rint(F.get("cell_mv", F.lit(i))).try_cast("int").alias(f"voltage_cell{i:03d}") for i in range(MAX_CELLS)]
        # the format has MAX_CELLS cells; how many a sample has beyond them
        out.append(F.greatest(F.size("cell_mv") - MAX_CELLS, F.lit(0)).alias("cells_left_out"))
    return flat.select(*out)


def decode_fixed_point(encoded: DataFrame) -> DataFrame:
    back = {n: F.col(n) / float(s) for n, s in INT_SCALE.items() if n in encoded.columns}
    back |= {n: F.col(n).cast("double") for n in FLOAT_FIELDS if n in encoded.columns}
    return encoded.withColumns(back)


#: fixed value: one exported sample per device in this time
EXPORT_INTERVAL_S = 15.0


def export_anonymized(
    flat: DataFrame, devices: DataFrame, user_id: str, interval_s: float = EXPORT_INTERVAL_S, tl: Timeline = DEVICE_TIME,
    did: str | None = None, changes: bool = False, refresh: Column | None = None,
) -> DataFrame:
    """Real devices only, under hashed ids, throttled, in the compact encoding with raw cells and no meters.

    `devices` is (device, address, type, is_virtual). With `changes`, a kept sample holds just the fields that differ
    from the kept one before it (all of them where `refresh` holds), and is left out if none does. `did` adds the
    hash of the exporting machine's id. Runs only when called: nothing exports by default.
    """
    tl = tl.of(flat)
    real = devices.filter(~F.col("is_virtual") & ~F.col("type").contains("dummy")).select(
        "device", F.col("type").alias("slug"), hash_id("address").alias("addrh")
    )
    # devices meet the kept rows: a join of all rows would put a device's in one task
    kept = throttle(flat, interval_s, "__kept", tl=tl).filter("__kept").drop("__kept").join(real, "device")
    enc = encode_fixed_point(kept, (*tl.keys, *[c for c in tl.order], "slug", "addrh"))
    enc = enc.withColumn("device", F.concat_ws("_", "slug", "addrh"))
    if changes:
        tags = {*tl.keys, *tl.order, "slug", "addrh"}
        enc = changed_only(enc, [c for c in enc.columns if c not in tags], refresh, tl)
    if did is not None:
        enc = enc.withColumn("did", hash_id(F.lit(did)))
    return enc.withColumn("uid", F.lit(user_id)).withColumn("time_ms", point_time_ms(tl.time))


#: fixed values: how often meters are written, and their decimals in the store and on the bus
METER_PERIOD_S = 30
METER_DIGITS = {"store": 5, "bus": 3}


def meter_points(readings: DataFrame, meters: Sequence[str], period_s: int = METER_PERIOD_S, target: str = "store", tl: Timeline = DEVICE_TIME) -> DataFrame:
    """The last reading of each period."""
    tl = tl.of(readings)
    d = METER_DIGITS[target]
    us = period_s * 1_000_000
    last = (
        readings.groupBy(*tl.keys, F.expr(f"(unix_micros({tl.time}) - pmod(unix_micros({tl.time}), {us})) div 1000000").alias("period"))
        .agg(F.max_by(F.struct(*meters), tl.order_key()).alias("m"))
    )
    return last.select(*tl.keys, "period", *[round_half_even(F.col(f"m.{m}"), d).alias(f"meter_{m}") for m in meters])


_ENTITY = "array<struct<topic:string,value:double,state:string>>"


def _num(topic: Column | str, value: Column) -> Column:
    topic = F.lit(topic) if isinstance(topic, str) else topic
    return F.struct(topic.alias("topic"), value.cast("double").alias("value"), F.lit(None).cast("string").alias("state"))


def _state(topic: Column | str, state: Column) -> Column:
    topic = F.lit(topic) if isinstance(topic, str) else topic
    return F.struct(topic.alias("topic"), F.lit(None).cast("double").alias("value"), state.alias("state"))


def entity_state(df: DataFrame, ident: Sequence[str] = ("device", "ts")) -> DataFrame:
    """Wide sample -> one row per entity: numbers in `value`, labels in `state`.

    All entities of a sample are built in one projection and exploded, so the samples are read once.
    """
    have = set(df.columns)
    on = lambda c: F.when(c, "ON").when(~c, "OFF")
    parts = [F.array(*[_num(t, round_sig(f, sig)) for t, (f, _, _, _, _, sig) in ENTITIES.items() if f in have])]
    if "switches" in have:
        parts.append(F.transform(F.map_entries("switches"), lambda e: _state(F.concat(F.lit("switch/"), e["key"]), on(e["value"]))))
    for flag in ("problem", "battery_charging"):
        if flag in have:
            parts.append(F.array(_state(flag, on(F.col(flag)))))
    if "problem_code" in have:
        parts.append(F.array(_num("problem_code", F.col("problem_code"))))
    if "battery_mode" in have:
        parts.append(F.array(_state("battery_mode", F.col("battery_mode"))))
    if "cell_mv" in have:
        at = lambda i: F.concat(F.lit("cell_voltages/"), (i + 1).cast("string"))
        parts.append(F.transform("cell_mv", lambda v, i: _num(at(i), v / 1000.0)))
        df, s = df.withColumn("__stats", cell_stats("cell_mv")), F.col("__stats")
        parts.append(F.array(*[_num(f"cell_voltages/{n}", s[n]) for n in ("min", "min_index", "max", "max_index", "delta", "average", "median")]))
    if "temperatures" in have:
        at_t = lambda i: F.concat(F.lit("temperatures/"), (i + 1).cast("string"))
        parts.append(F.transform("temperatures", lambda v, i: _num(at_t(i), round_sig(v, 4))))
    empty = F.array().cast(_ENTITY)
    every = F.concat(*[F.coalesce(p, empty) for p in parts])
    name = topic_prefix("device").alias("__name")
    return df.select(*ident, name, F.explode(every).alias("e")).filter("e.value IS NOT NULL OR e.state IS NOT NULL").select(
        *ident, F.concat("__name", F.lit("/"), F.col("e.topic")).alias("topic"), "e.value", "e.state"
    )


def _meta(topic, name, unit, cls, state, precision) -> Column:
    lit = lambda v, t: F.lit(v).cast(t)
    return F.struct(
        (topic if isinstance(topic, Column) else F.lit(topic)).alias("topic"),
        (name if isinstance(name, Column) else lit(name, "string")).alias("name"),
        lit(unit, "string").alias("unit"), lit(cls, "string").alias("device_class"),
        lit(state, "string").alias("state_class"), lit(precision, "int").alias("precision"),
    )


def entity_catalog(df: DataFrame) -> DataFrame:
    """Entities each device exposes, with unit, class and precision, from one aggregate per device."""
    have = set(df.columns)
    fields = [(t, m) for t, m in ENTITIES.items() if m[0] in have]
    flags = [f for f in ("problem", "problem_code", "battery_charging", "battery_mode") if f in have]
    aggs = [F.max(F.col(m[0]).isNotNull()).alias(f"has_{m[0]}") for _, m in fields]
    aggs += [F.max(F.col(f).isNotNull()).alias(f"has_{f}") for f in flags]
    if "cell_mv" in have:
        aggs.append(F.coalesce(F.max(F.size("cell_mv")), F.lit(0)).alias("n_cells"))
    if "temperatures" in have:
        aggs.append(F.coalesce(F.max(F.size("temperatures")), F.lit(0)).alias("n_temps"))
    if "switches" in have:
        aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("switches"))))).alias("switch_names"))
    per = df.groupBy("device").agg(*aggs)
    none = F.lit(None)
    parts = [F.array(*[F.when(F.col(f"has_{f}"), _meta(t, f, u, c, s, p)) for t, (f, u, c, s, p, _) in fields])]
    numbered = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(1), F.col(n))).otherwise(F.array().cast("array<int>"))
    if "cell_mv" in have:
        parts.append(F.transform(numbered("n_cells"), lambda i: _meta(F.concat(F.lit("cell_voltages/"), i.cast("string")), F.concat(F.lit("Cell Volt "), i.cast("string")), "V", "voltage", None, 3)))
        stats = [_meta(f"cell_voltages/{s}", f"Cell Volt {s}", "V", "voltage", None, 3) for s in ("min", "max", "average", "median", "delta")]
        stats += [_meta(f"cell_voltages/{s}_index", f"Cell Index {s}", None, None, None, None) for s in ("min", "max")]
        parts.append(F.array(*[F.when(F.col("n_cells") > 1, s) for s in stats]))
    if "temperatures" in have:
        parts.append(F.transform(numbered("n_temps"), lambda i: _meta(F.concat(F.lit("temperatures/"), i.cast("string")), F.concat(F.lit("Temperatures "), i.cast("string")), "°C", "temperature", None, 1)))
    parts.append(F.array(*[_meta(t, t.split("/")[1].replace("_", " "), u, c, s, p) for t, (u, c, s, p) in METER_ENTITIES.items()]))
    classes = {"problem": "problem", "problem_code": None, "battery_charging": "battery_charging", "battery_mode": "enum"}
    parts.append(F.array(*[F.when(F.col(f"has_{f}"), _meta(f, f.replace("_", " "), None, classes[f], None, None)) for f in flags]) if flags else F.array().cast("array<struct<topic:string,name:string,unit:string,device_class:string,state_class:string,precision:int>>"))
    if "switches" in have:
        parts.append(F.transform("switch_names", lambda s: _meta(F.concat(F.lit("switch/"), s), s, None, "outlet", None, None)))
    every = F.array_compact(F.concat(*parts))
    return per.select("device", F.explode(every).alias("e")).select("device", "e.*")


def entity_discovery(df: DataFrame, expire_s: int) -> DataFrame:
    """What is announced for each entity: the catalog with its component, full name and the seconds after which a silent entity is unavailable.

    Cells are numbered with leading zeros as wide as the pack needs, probes are announced only if they ever had a value, meters expire no
    sooner than METER_EXPIRY_S, and a switch is announced as a switch and as a sensor of its state.
    """
    cat = entity_catalog(df)
    number = F.regexp_extract("topic", "^(cell_voltages|temperatures)/([0-9]+)$", 2).try_cast("int")
    cat = cat.withColumn("__n", number)
    cell, probe = F.col("topic").startswith("cell_voltages/"), F.col("topic").startswith("temperatures/")
    if "temperatures" in df.columns:
        # positions with a value, a few per device
        some = F.transform(F.col("temperatures"), lambda t, i: F.when(t.isNotNull(), i + 1))
        known = df.groupBy("device").agg(F.array_distinct(F.flatten(F.collect_set(F.array_compact(some)))).alias("__probes"))
        cat = cat.join(known, "device", "left").filter(~F.coalesce(probe, F.lit(False)) | F.array_contains(F.coalesce("__probes", F.array().cast("array<int>")), F.col("__n"))).drop("__probes")
    # entities of one device: as many as it has cells, probes and fields
    width = F.length(F.max(F.when(cell, F.col("__n"))).over(Window.partitionBy("device")).cast("string"))
    words = F.array_join(F.transform(F.split(F.col("name"), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), " ")
    meter = F.create_map(*[F.lit(x) for pair in METER_NAMES.items() for x in pair])[F.col("topic")]
    plain = F.col("topic").isin(*ENTITIES)
    name = F.when(cell & F.col("__n").isNotNull(), F.concat(F.lit("Cell Volt "), F.lpad(F.col("__n").cast("string"), width, "0"))).when(plain, words).otherwise(F.coalesce(meter, F.col("name")))
    switch = F.col("topic").startswith("switch/")
    component = F.when(switch, "switch").when(F.col("topic").isin("problem", "battery_charging"), "binary_sensor").otherwise("sensor")
    expire = F.when(F.col("topic").startswith("meter/"), F.lit(max(expire_s, int(METER_EXPIRY_S)))).otherwise(F.lit(expire_s))
    out = cat.select("device", component.alias("component"), "topic", name.alias("name"), "unit", "device_class", "state_class", "precision", expire.cast("int").alias("expire_after"))
    state = out.filter(F.col("component") == "switch").withColumns({"component": F.lit("binary_sensor"), "name": F.concat("name", F.lit(" switch")), "device_class": F.lit("power")})
    return out.unionByName(state)


# --- writers ----------------------------------------------------------------------------------


def write_partitioned(points: DataFrame, path: str, time: str = "ts", sort: Sequence[str] = ("device", "ts"), mode: str = "append") -> None:
    """Date partitions, files sorted by device and time so that later scans prune and compress well.

    The range shuffle splits on (date, device, time), so one device that dominates a day still
    spreads over several files.
    """
    (
        points.withColumn("date", F.to_date(time))
        .repartitionByRange("date", *sort)
        .sortWithinPartitions("date", *sort)
        .write.mode(mode).partitionBy("date").option("maxRecordsPerFile", 5_000_000).parquet(path)
    )


def fan_out(sinks: Mapping[str, Callable[[DataFrame, int], None]], on_error: Callable[[str, Exception], None] | None = None):
    """A `foreachBatch` function that feeds several sinks; a failing sink does not stop the others."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(batch, batch_id)
                except Exception as e:  # one sink's failure is its own
                    (on_error or (lambda n, x: print(f"sink {n} failed: {type(x).__name__}: {x}")))(name, e)
        finally:
            batch.unpersist()

    return run
