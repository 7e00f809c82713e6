"""Row-level measures as column expressions: everything here stays inside one projection."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is the missing marker of the devices; here it becomes NULL once, at the source."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.nanvl(f.name, F.lit(None).cast(f.dataType))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.DoubleType, T.FloatType)):
            out[f.name] = F.transform(f.name, _null_for_nan(f.dataType.elementType))
    return df.withColumns(out) if out else df


def _null_for_nan(kind: T.DataType):
    return lambda x: F.nanvl(x, F.lit(None).cast(kind))


def power(explicit: Column | str, voltage: Column | str = "voltage", current: Column | str = "current") -> Column:
    return F.coalesce(col(explicit), col(voltage) * col(current))


def round_half_even(c: Column, digits: int = 0) -> Column:
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def round_sig(c: Column | str, n: int = 5) -> Column:
    """`n` significant digits; zero and NULL stay as they are."""
    c = col(c)
    d = F.lit(n - 1.0) - F.floor(F.log10(F.abs(c)))
    up = F.rint(c * F.pow(F.lit(10.0), d)) / F.pow(F.lit(10.0), d)
    # a negative digit count rounds to tens; dividing by an exact power keeps the value exact
    down = F.rint(c / F.pow(F.lit(10.0), -d)) * F.pow(F.lit(10.0), -d)
    return F.when(c == 0, c).when(d >= 0, up).otherwise(down)


def derive_soc_capacity(df: DataFrame) -> DataFrame:
    """Recompute the state of charge from charge/capacity, or the capacity from charge/soc."""
    q, cap, soc = F.col("charge"), F.col("capacity"), F.col("soc")
    from_ratio = (cap > 0) & (soc.isNull() | (F.coalesce("soc_is_int", F.lit(False)) & (q > 0)))
    new_soc = F.when(from_ratio, round_half_even(q / cap * 100, 2)).otherwise(soc)
    from_soc = cap.isNull() & (soc > 0.2) & q.isNotNull()
    new_cap = F.when(from_soc, F.rint(q / soc * 100)).otherwise(cap)
    return df.withColumns({"soc": new_soc, "capacity": new_cap})


def derive_soh_aged(df: DataFrame) -> DataFrame:
    cap, aged, soh = F.col("capacity"), F.col("aged_capacity"), F.col("soh")
    ok = cap > 0
    return df.withColumns(
        {
            "aged_capacity": F.when(ok & aged.isNull() & soh.isNotNull(), cap * soh / 100).otherwise(aged),
            "soh": F.when(ok & soh.isNull() & aged.isNotNull(), aged / cap * 100).otherwise(soh),
        }
    )


def derive_problem(problem: Column | str = "problem", code: Column | str = "problem_code") -> Column:
    return F.coalesce(col(problem), col(code) != 0)


def calibrate(c: Column | str, factor: Column | float) -> Column:
    """Multiply; a zero reading keeps its positive zero."""
    c = col(c)
    return F.when(c != 0, c * factor).otherwise(c)


def invert(c: Column | str) -> Column:
    return calibrate(c, F.lit(-1.0))


#: fixed value: no reading expires sooner than this
MIN_EXPIRY_S = 20.0


def expire_after(expire_s: float, sample_period: float, publish_period: float) -> float:
    """The configured expiry, stretched to twice the slower of the two periods; 0 keeps it off."""
    return expire_s and max(expire_s, int(sample_period * 2 + 0.5), int(publish_period * 2 + 0.5))


def is_fresh(expire_s: float = 0.0, time: str = "ts", ingest: str = "ingest_ts") -> Column:
    age_us = F.unix_micros(F.col(ingest)) - F.unix_micros(F.col(time))
    return age_us <= int(max(expire_s, MIN_EXPIRY_S) * 1e6)


def drop_expired(df: DataFrame, expire_s: float = 0.0) -> DataFrame:
    return df.filter(is_fresh(expire_s))


#: fixed values: "no value" codes per vendor and raw field
SENTINELS: dict[tuple[str, str], tuple[int, ...]] = {
    ("ant", "temperature"): (65496,),
    ("jk", "temperature"): (-2000,),
    ("modbus", "cell"): (0xEE49, 0),
    ("victron", "soc"): (0xFFFF,),
    ("victron", "charge"): (0x7FFFFFFF,),
}


def sentinel_to_null(raw: Column | str, vendor: Column | str, field: str) -> Column:
    """NULL where the vendor's raw code means "no value"."""
    out, raw, vendor = None, col(raw), col(vendor)
    for (v, f), codes in SENTINELS.items():
        if f == field:
            hit = (vendor == v) & raw.isin(*codes)
            out = F.when(hit, None) if out is None else out.when(hit, None)
    return raw if out is None else out.otherwise(raw)


def drop_sentinels(raw: Column | str, codes: Sequence[int]) -> Column:
    return F.filter(col(raw), lambda x: ~x.isin(*codes))


#: fixed values: most cells and temperature probes of a plausible frame, per vendor
VENDOR_LIMITS = {"pace": (16, 8)}


def reject_reason(soc="soc", cells="cell_mv", temperature="mos_temperature", max_cells: int | None = None, spike_mv: int = 48_000) -> Column:
    """First rule a sample breaks, or NULL. A largest number of cells belongs to a vendor, so there is none unless given
    (see `VENDOR_LIMITS`); cell range is opt-in: see `cell_range_reason`."""
    cells = col(cells)
    return (
        F.when((col(soc) < 0) | (col(soc) > 100), "soc_range")
        .when((F.size(cells) < 1) | (F.size(cells) > F.lit(max_cells) if max_cells is not None else F.lit(False)), "cell_count")
        .when(F.forall(cells, lambda v: v == 0), "all_cells_zero")
        .when(F.exists(cells, lambda v: v >= spike_mv), "cell_spike")
        .when((col(temperature) <= -100) | (col(temperature) >= 200), "temperature_range")
    )


def cell_range_reason(cells="cell_mv", low: int = 2000, high: int = 4500) -> Column:
    return F.when(F.array_min(col(cells)) < low, "cell_low").when(F.array_max(col(cells)) > high, "cell_high")


def quarantine(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad); the bad rows keep their reason."""
    marked = df.withColumn("reject_reason", reason)
    return marked.filter("reject_reason IS NULL").drop("reject_reason"), marked.filter("reject_reason IS NOT NULL")


def hash_id(s: Column | str) -> Column:
    """Anonymous id: every second byte of the SHA-1, URL-safe base64 without padding; empty gives NULL."""
    digest = F.unhex(F.regexp_replace(F.sha1(col(s).cast("binary")), "(..)(..)", "$2"))
    return F.when(F.length(col(s)) > 0, F.translate(F.base64(digest), "+/=", "-_"))


def topic_prefix(name: Column | str) -> Column:
    """Everything but word characters and the characters from `.` to `/` becomes `_`."""
    return F.regexp_replace(col(name), r"(?U)[^\w./]", "_")


def node_id(topic: Column | str) -> Column:
    return F.translate(col(topic), "/", "_")


#: fixed value: hours between full charges unless an algorithm names its own
CALIBRATION_H = 24 * 14


def parse_algorithm(text: Column | str) -> Column:
    """`soc 90% 70% 10% 20% 336`, or a JSON object with the same arguments by name -> struct.

    The arguments are charge_stop, charge_start, discharge_stop, discharge_start and calibration_interval_h; start is
    clamped to stop. Hours that are missing are CALIBRATION_H; null or empty ones by name mean no calibration.
    """
    t = F.trim(col(text))
    words, by_name = F.split(t, " +"), t.startswith("{")
    options = F.when(by_name, F.from_json(t, "map<string,string>"))
    given = lambda name, i: F.when(by_name, F.try_element_at(options, F.lit(name))).otherwise(F.get(words, F.lit(i)))
    number = lambda name, i: F.regexp_replace(given(name, i), "^%+|%+$", "").try_cast("double")
    stop = number("charge_stop", 1)
    start = F.coalesce(number("charge_start", 2), stop)
    named = F.coalesce(F.map_contains_key(options, "calibration_interval_h"), F.lit(False))
    hours = F.coalesce(number("calibration_interval_h", 5), F.when(named, 0.0).otherwise(float(CALIBRATION_H)))
    return F.struct(
        given("name", 0).alias("name"),
        stop.alias("charge_stop"),
        F.least(start, stop).alias("charge_start"),
        number("discharge_stop", 3).alias("discharge_stop"),
        number("discharge_start", 4).alias("discharge_start"),
        (hours * 3600.0).alias("calibration_s"),
    )


def bits(code: Column | str, names: Sequence[str]) -> Column:
    """Bit i of the code under the i-th name."""
    return F.map_from_arrays(
        F.array(*[F.lit(n) for n in names]),
        F.array(*[F.getbit(col(code), F.lit(i)) == 1 for i in range(len(names))]),
    )


#: fixed values: digital inputs and outputs of the state frame
IO_NAMES = ("DI1", "DI2", "DI3", "DI4", "DO1", "DO2", "DO3", "DO4")

#: fixed values: working-state flag -> mask (any bit set), except `status_normal`
STATE_MASKS = {
    "status_charging": 0x0001,
    "status_discharging": 0x0002,
    "status_protection": 0x000C,
    "status_overvolt_protection": 0x0004,
    "status_undervolt_protection": 0x0008,
    "status_short": 0x0020,
    "status_overtemp": 0x0500,
    "status_undertemp": 0x0A00,
}
NORMAL_MASK = 0xF003
NORMAL_MIN = 0xF000


def working_state(code: Column | str) -> dict[str, Column]:
    c = col(code)
    flags = {n: c.bitwiseAND(F.lit(m)) > 0 for n, m in STATE_MASKS.items()}
    flags["status_normal"] = c.bitwiseAND(F.lit(NORMAL_MASK)) >= NORMAL_MIN
    return flags


def packed_cell(word: Column | str) -> Column:
    """A 16-bit cell word: low 12 bits are mV, the top bit says the cell is balancing."""
    w = col(word)
    return F.struct(
        w.bitwiseAND(F.lit(0x0FFF)).alias("mv"), (w.bitwiseAND(F.lit(0x8000)) > 0).alias("balancing")
    )


#: fixed values: labels of the mode code; any other code is "discharging"
MODE_LABELS = {0: "stationary", 1: "charging"}


def mode_label(code: Column | str) -> Column:
    out = F.when(col(code).isNull(), None)
    for value, label in MODE_LABELS.items():
        out = out.when(col(code) == value, label)
    return out.otherwise("discharging")


#: fixed values: benign bits that are left out of alarm codes
FULLY_CHARGED = 0x80
WARN_FULLY_CHARGED = 0x10
STATE_PROTECTION_MASK = 0x7F


def alarm_code_three(protect1: Column, protect2: Column, fault: Column) -> Column:
    """protect1 | protect2 without "fully charged" << 8 | fault << 16."""
    masked = protect2.bitwiseAND(F.lit(0xFF & ~FULLY_CHARGED))
    return protect1.bitwiseOR(F.shiftleft(masked, 8)).bitwiseOR(F.shiftleft(fault, 16))


def alarm_code_states(chg: Column, dis: Column, warn_chg: Column, warn_dis: Column, benign: int = WARN_FULLY_CHARGED) -> Column:
    """Protection bits of both state bytes, then both warning bytes without the benign one."""
    mask = F.lit(STATE_PROTECTION_MASK)
    return (
        chg.bitwiseAND(mask)
        .bitwiseOR(F.shiftleft(dis.bitwiseAND(mask), 8))
        .bitwiseOR(F.shiftleft(warn_chg.bitwiseAND(F.lit(0xFF & ~benign)), 16))
        .bitwiseOR(F.shiftleft(warn_dis.cast("long"), 24))
    )


def alarm_code_table(status_bytes: Column, table: Sequence[tuple[int, int, int, int]]) -> Column:
    """Or together the error masks of the set bits; the table rows are (offset, mask, kind, error mask)."""
    code = F.lit(0)
    for offset, mask, kind, error in table:
        if kind >= 1:
            hit = F.coalesce(F.get(status_bytes, F.lit(offset)), F.lit(0)).bitwiseAND(F.lit(mask)) > 0
            code = code.bitwiseOR(F.when(hit, F.lit(error)).otherwise(F.lit(0)))
    return code


def pack_voltage(voltage: Column | str = "voltage", cells: Column | str = "cell_mv") -> Column:
    total = F.aggregate(col(cells), F.lit(0).cast("long"), lambda a, v: a + v)
    return F.coalesce(col(voltage), total / 1000.0)


def soc_from_full(remaining: Column, full: Column) -> Column:
    return F.when(full > 0, remaining / full * 100)


def soh_from_design(full: Column, design: Column) -> Column:
    return F.when(design > 0, F.least(F.lit(100.0), full / design * 100))


def soc_from_aged(charge: Column, aged: Column, reported: Column) -> Column:
    return F.when((charge > 0) & (aged > 0), round_half_even(charge / aged * 100, 2)).otherwise(reported)


def charge_from_soc(capacity: Column, soc: Column) -> Column:
    return capacity * soc / 100


def net_current(charge_a: Column, discharge_a: Column, absurd_a: float = 500.0) -> Column:
    """Two unsigned channels -> one signed current; an absurd channel counts as zero."""
    ok = lambda c: F.when(c > absurd_a, F.lit(0.0)).otherwise(c)
    return ok(discharge_a) - ok(charge_a)


def roles_by_position(temps: Column | str, mos_at: int = 4) -> Column:
    """First `mos_at` sensors are cells, the next one is the MOSFET, the rest follow the cells."""
    t = col(temps)
    n = F.size(t)
    cells = F.slice(t, 1, mos_at)
    rest = F.when(n > mos_at + 1, F.slice(t, F.lit(mos_at + 2), F.greatest(n - mos_at - 1, F.lit(0)))).otherwise(F.slice(t, 1, 0))
    return F.struct(F.concat(cells, rest).alias("temperatures"), F.get(t, F.lit(mos_at)).alias("mos_temperature"))


#: fixed values: sensor tags
TAG_MOS, TAG_AMBIENT = 0x40, 0x20


def roles_by_tag(sensors: Column | str) -> Column:
    """Array of struct(tag, value) -> cells (+ ambient at the end) and the MOSFET sensor."""
    s = col(sensors)
    pick = lambda tag: F.transform(F.filter(s, lambda x: x["tag"] == tag), lambda x: x["value"])
    cells = F.transform(F.filter(s, lambda x: ~x["tag"].isin(TAG_MOS, TAG_AMBIENT)), lambda x: x["value"])
    ambient = F.slice(F.reverse(pick(TAG_AMBIENT)), 1, 1)
    return F.struct(F.concat(cells, ambient).alias("temperatures"), F.try_element_at(pick(TAG_MOS), F.lit(-1)).alias("mos_temperature"))


def cap_sensors(temps: Column | str, n: int = 8) -> Column:
    """The first n sensors, for the vendor whose frames have room for eight; other layouts keep all theirs."""
    return F.slice(col(temps), 1, n)


def flatten_columns(
    scalars: Sequence[str], switches: Sequence[str] = (), n_temps: int = 0, n_cells: int = 0
) -> list[Column]:
    """Wide flat columns from the nested ones: `switches_charge`, `temperatures_0`, ..."""
    out = [F.col(c) for c in scalars]
    out += [F.element_at("switches", F.lit(s)).alias(f"switches_{s}") for s in switches]
    out += [F.get("temperatures", F.lit(i)).alias(f"temperatures_{i}") for i in range(n_temps)]
    out += [F.get("cell_mv", F.lit(i)).alias(f"voltage_cell{i:03d}") for i in range(n_cells)]
    return out


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often `use` refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cell_stats(cells: Column | str = "cell_mv") -> Column:
    """min, max, first 1-based index of each, delta, mean (rounded mV) and median, in volts."""
    raw = col(cells)

    def stats(srt: Column) -> Column:
        n = F.size(srt)
        mid = F.floor(n / 2).cast("int")
        median = F.when(n % 2 == 1, F.get(srt, mid)).otherwise((F.get(srt, mid - 1) + F.get(srt, mid)) / 2.0)
        total = F.aggregate(srt, F.lit(0).cast("long"), lambda a, v: a + v)
        lo, hi = F.get(srt, F.lit(0)), F.get(srt, n - 1)
        found = F.struct(
            (lo / 1000.0).alias("min"),
            F.array_position(raw, lo).alias("min_index"),
            (hi / 1000.0).alias("max"),
            F.array_position(raw, hi).alias("max_index"),
            ((hi - lo) / 1000.0).alias("delta"),
            (F.rint(total / n) / 1000.0).alias("average"),
            (median / 1000.0).alias("median"),
        )
        return F.when(n > 1, found)

    return once(F.sort_array(F.filter(raw, lambda v: v.isNotNull())), stats)


def normalize_vendor(df: DataFrame, mapping: Mapping[str, Sequence[str] | Column]) -> DataFrame:
    """Canonical columns from vendor columns: the first present source wins, or an expression."""
    out = []
    for name, src in mapping.items():
        if isinstance(src, Column):
            out.append(src.alias(name))
        else:
            have = [F.col(s) for s in src if s in df.columns]
            out.append((F.coalesce(*have) if have else F.lit(None)).alias(name))
    return df.select(*out)
