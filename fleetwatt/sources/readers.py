"""Sources: canonical samples, cells, vendor samples, device options, ambient payloads, signal logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwatt.functions.scalar import nan_to_null, normalize_vendor
from fleetwatt.operators.prefix import scan
from fleetwatt.operators.timeline import DEVICE_TIME, Timeline, micros
from fleetwatt.schema import CELLS, DEVICE_OPTIONS, SAMPLES


def read_samples(spark: SparkSession, path: str, schema: T.StructType = SAMPLES, streaming: bool = False) -> DataFrame:
    """Typed scan; columns a file lacks are NULL, NaN becomes NULL. Filters on device and date reach the scan."""
    reader = spark.readStream if streaming else spark.read
    return nan_to_null(reader.schema(schema).parquet(path))


def read_cells(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return (spark.readStream if streaming else spark.read).schema(CELLS).parquet(path)


def cells_long(samples: DataFrame, keys: Sequence[str] = ("device", "ts")) -> DataFrame:
    """One row per cell; a sample without cells gives no row."""
    return samples.select(*keys, F.posexplode("cell_mv").alias("cell_index", "mv"))


def cells_wide(cells: DataFrame, keys: Sequence[str] = ("device", "ts")) -> DataFrame:
    """Back to one array per sample, ordered by cell index (a pack has few cells)."""
    packed = F.array_sort(F.collect_list(F.struct("cell_index", "mv")))
    return cells.groupBy(*keys).agg(F.transform(packed, lambda x: x["mv"]).alias("cell_mv"))


#: fixed values: charging stages by code
BATTERY_MODES = ("UNKNOWN", "BULK", "ABSORPTION", "FLOAT")


def plugin_mapping(df: DataFrame) -> dict[str, Sequence[str] | Column]:
    """Samples of the generic plug-in family: positive current charges, cells in volts, old and new switch names."""
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in df.columns]) if any(n in df.columns for n in names) else F.lit(None).cast("boolean")
    switches = F.map_from_entries(
        F.filter(
            F.array(
                F.struct(F.lit("charge").alias("k"), first("sw_chrg_mosfet", "chrg_mosfet").alias("v")),
                F.struct(F.lit("discharge").alias("k"), first("sw_dischrg_mosfet", "dischrg_mosfet").alias("v")),
            ),
            lambda e: e["v"].isNotNull(),
        )
    )
    mode = F.get(F.array(*[F.lit(m) for m in BATTERY_MODES]), F.col("battery_mode").cast("int"))
    return {
        "device": ("device",),
        "ts": ("ts",),
        "soc": ("battery_level",),
        "soh": ("battery_health",),
        "voltage": ("voltage",),
        "current": -F.col("current"),
        "power": -F.col("power"),
        "charge": ("cycle_charge",),
        "capacity": ("design_capacity",),
        "total_charge_throughput": ("cycle_capacity",),
        "num_cycles": ("cycles",),
        "balance_current": ("balance_current",),
        "temperatures": F.array("temperature") if "temperature" in df.columns else F.lit(None).cast("array<double>"),
        "switches": F.when(F.size(switches) > 0, switches),
        "problem": ("problem",),
        "problem_code": ("problem_code",),
        "runtime": ("runtime",),
        "battery_charging": ("battery_charging",),
        "battery_mode": mode,
        "total_charge_net": ("total_charge",),
        "cell_mv": F.transform(
            F.slice("cell_voltages", F.lit(1), F.col("cell_count")), lambda v: F.round(v * 1000).cast("int")
        ),
    }


def normalize_plugin(df: DataFrame) -> DataFrame:
    return normalize_vendor(df, plugin_mapping(df))


def union_vendors(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def read_devices(spark: SparkSession, path: str) -> DataFrame:
    """The monitor's options document (one JSON object with a `devices` list)."""
    schema = T.StructType([T.StructField("devices", T.ArrayType(DEVICE_OPTIONS))])
    docs = spark.read.schema(schema).json(path, multiLine=True)
    return normalize_devices(docs.select(F.explode("devices").alias("d")).select("d.*"))


def parse_device_docs(docs: DataFrame, column: str = "doc") -> DataFrame:
    """One JSON object per row instead of one document."""
    return normalize_devices(docs.select(F.from_json(column, DEVICE_OPTIONS).alias("d")).select("d.*"))


def normalize_devices(entries: DataFrame) -> DataFrame:
    """Trim, drop disabled entries, split `type:spec` and the `;` list of algorithms, default the calibration."""
    address = F.trim(F.coalesce("address", F.lit("")))
    kind = F.split(F.trim(F.coalesce("type", F.lit(""))), ":", 2)
    spec = F.trim(F.get(kind, F.lit(1)))
    algorithm = F.filter(F.transform(F.split("algorithm", ";"), lambda a: F.trim(a)), lambda a: a != "")
    return entries.filter((address != "") & ~address.startswith("#")).select(
        F.coalesce(F.trim("alias"), address).alias("device"),
        address.alias("address"),
        F.trim(F.get(kind, F.lit(0))).alias("type"),
        F.when(spec != "", spec).alias("spec"),
        F.coalesce("current_calibration", F.lit(1.0)).alias("current_calibration"),
        algorithm.alias("algorithms"),
        F.coalesce("debug", F.lit(False)).alias("debug"),
        "pin",
        "adapter",
    )


GROUP_TYPE = "group_parallel"


def read_group_members(devices: DataFrame) -> DataFrame:
    """Groups list their members in `address`; empty and repeated members are dropped, order is kept."""
    members = F.array_distinct(
        F.filter(F.transform(F.split("address", ","), lambda m: F.trim(m)), lambda m: m != "")
    )
    return devices.filter(F.col("type") == GROUP_TYPE).select(
        F.col("device").alias("group"), F.posexplode(members).alias("ord", "member")
    )


#: fixed values: payload keys in the order they are tried
PAYLOAD_KEYS = ("value", "state", "temperature", "temp", "t")


def parse_ambient(payload: Column | str) -> Column:
    """Degrees from a number or a JSON object; the first present key decides; out of range is NULL."""
    text = F.trim(F.col(payload) if isinstance(payload, str) else payload)
    picked = None
    for key in PAYLOAD_KEYS:
        value = F.get_json_object(text, f"$.{key}")
        picked = F.when(value.isNotNull(), value) if picked is None else picked.when(value.isNotNull(), value)
    number = F.when(text.startswith("{"), picked).otherwise(text).try_cast("double")
    return F.when(~F.isnan(number) & (number > -100) & (number < 200), number)


def assemble_signals(
    updates: DataFrame, signals: Sequence[str], max_age_s: float = 10.0, tl: Timeline = DEVICE_TIME
) -> DataFrame:
    """Signal log (device, signal, ts, value) -> one wide row per update with the last known values.

    `sample_ts` is the time of the newest known signal; `stale_<signal>` marks values older than `max_age_s`.
    """
    seen = F.struct(micros(tl.time).alias("t"), F.col("value").alias("v"))
    wide = scan(updates, tl, last={s: F.when((F.col("signal") == s), seen) for s in signals})
    now = micros(tl.time)
    return wide.select(
        *tl.keys,
        *[c for c in tl.order],
        F.timestamp_micros(F.greatest(*[F.when(F.col(s)["v"].isNotNull(), F.col(s)["t"]) for s in signals])).alias("sample_ts"),
        *[F.col(s)["v"].alias(s) for s in signals],
        *[(now - F.col(s)["t"] > int(max_age_s * 1e6)).alias(f"stale_{s}") for s in signals],
    )
