"""Captured frames: the readings of `events`, packed into vendor frames and read back.

The builders below only make the inputs. Each oracle computes the expected readings straight from
`events`, without any bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetwatt.functions import frames as B
from fleetwatt.operators import algorithms
from fleetwatt.operators import frames as R
from fleetwatt.operators import prefix
from fleetwatt.operators.fold import Fold
from fleetwatt.plans.registry import query, r6
from fleetwatt.plans.telemetry import TEL, samples


def hex_int(v: Column | int, n: int, endian: str = "big") -> Column:
    v = (F.lit(v) if isinstance(v, int) else v).cast("long")
    if endian == "little" and n > 1:
        swapped = F.lit(0).cast("long")
        for i in range(n):
            swapped = swapped.bitwiseOR(F.shiftleft(F.shiftright(v, 8 * i).bitwiseAND(F.lit(255)), 8 * (n - 1 - i)))
        v = swapped
    return F.lpad(F.hex(v.bitwiseAND(F.lit((1 << 8 * n) - 1 if n < 8 else -1))), 2 * n, "0")


def packed(n_bytes: int, parts: dict[int, tuple]) -> Column:
    """Hex text of `n_bytes` with the parts at their offsets and zeros between."""
    out, at = [], 0
    for offset in sorted(parts):
        text, width, _ = parts[offset]
        out += [F.lit("00" * (offset - at)), text]
        at = offset + width
    return F.concat(*out, F.lit("00" * (n_bytes - at)))


def sum_of(parts: dict[int, tuple]) -> Column:
    """Sum of all bytes of the parts."""
    total = F.lit(0).cast("long")
    for _, _, subtotal in parts.values():
        total = total + subtotal
    return total


def field(v, n, endian="big"):
    """(hex text, width, sum of its bytes) of an integer."""
    v = F.lit(v) if isinstance(v, int) else v
    digits = F.lit(0).cast("long")
    for i in range(n):
        digits = digits + F.shiftright(v.cast("long"), 8 * i).bitwiseAND(F.lit(255))
    return hex_int(v, n, endian), n, digits


def literal(text: str):
    raw = bytes.fromhex(text)
    return F.lit(text), len(raw), F.lit(sum(raw)).cast("long")


def off_by_one(byte_text: Column) -> Column:
    return hex_int(F.conv(byte_text, 16, 10).cast("int") + 1, 1)


def E() -> Column:
    return F.col("event_id")


def K() -> Column:
    return F.col("k")


def V() -> Column:
    return F.col("value")


def jbd_info_frame() -> Column:
    raw_current = F.floor((50 - V()) * 10)
    mos = F.col("switches")["charge"].cast("int") + 2 * F.col("switches")["discharge"].cast("int")
    parts = {
        0: field(4800 + 5 * K(), 2), 2: field(raw_current, 2), 4: field(100 * K(), 2), 6: field(10000, 2), 8: field(E() % 1000, 2),
        16: field(F.col("problem_code"), 2), 19: field(K(), 1), 20: field(mos, 1), 21: field(4, 1), 22: field(2, 1),
        23: field(2731 + 150 + F.floor(V()), 2), 25: field(2731 + 2 * K() - 100, 2),
    }
    check = hex_int(0x10000 - 0x1B - sum_of(parts), 2)
    return F.concat(F.lit("DD03001B"), packed(27, parts), check, F.lit("77"))


JBD_SQL = """round((4800 + 5 * k) / 100.0::DOUBLE, 6) AS voltage, round(-floor((50 - value) * 10) / 100.0::DOUBLE, 6) + 0.0 AS current, k::DOUBLE AS charge, 100.0::DOUBLE AS capacity, event_id % 1000 AS num_cycles,
  problem_code, k AS soc, sw_charge AS switch_charge, sw_discharge AS switch_discharge, 4 AS n_cells, round((150 + floor(value)) / 10.0::DOUBLE, 6) AS temperature_0, round((2 * k - 100) / 10.0::DOUBLE, 6) + 0.0 AS temperature_1"""


@query("decode_jbd", f"WITH {TEL} SELECT event_id, device, {JBD_SQL} FROM tel")
def decode_jbd(spark, sf_dir):
    df = samples(spark, sf_dir).select("event_id", "device", F.unhex(jbd_info_frame()).alias("frame"))
    df = R.decode_frames(df, "jbd_info")
    return df.select(
        "event_id", "device", *[r6(c).alias(c) for c in ("voltage", "current", "charge", "capacity")], "num_cycles", "problem_code", "soc",
        "switch_charge", "switch_discharge", "n_cells", r6(F.get("temperatures", F.lit(0))).alias("temperature_0"), r6(F.get("temperatures", F.lit(1))).alias("temperature_1"),
    )


@query("decode_jbd_cells", f"WITH {TEL} SELECT event_id, array_to_string(cell_mv, ',') AS cells FROM tel")
def decode_jbd_cells(spark, sf_dir):
    cells = F.concat(*[hex_int(F.get("cell_mv", F.lit(i)), 2) for i in range(4)])
    frame = F.unhex(F.concat(F.lit("DD040008"), cells, F.lit("000077")))
    df = R.decode_frames(samples(spark, sf_dir).select("event_id", frame.alias("frame")), "jbd_cells")
    return df.select("event_id", F.array_join(F.col("cell_mv").cast("array<string>"), ",").alias("cells"))


@query(
    "decode_daly",
    f"""WITH {TEL} SELECT event_id, round((480 + k) / 10.0::DOUBLE, 6) AS voltage, round((floor(value) - 500) / 10.0::DOUBLE, 6) + 0.0 AS current, round(k * 10 / 10.0::DOUBLE, 6) AS soc, CASE event_id % 3 WHEN 0 THEN 'stationary' WHEN 1 THEN 'charging' ELSE 'discharging' END AS mode,
 sw_charge AS charging_mosfet, round(event_id * 7 / 1000.0::DOUBLE, 6) AS charge, event_id % 30 AS num_cycles, (event_id % 16 & 2) > 0 AS di2, array_to_string([cell_mv[1], cell_mv[2], cell_mv[3]], ',') AS cells, array_to_string(list_transform(range(7), lambda i: k + i - 40), ',') AS temps FROM tel""",
)
def decode_daly(spark, sf_dir):
    from fleetwatt.functions.scalar import IO_NAMES, bits, mode_label

    c = [F.get("cell_mv", F.lit(i)) for i in range(3)]
    df = samples(spark, sf_dir).select(
        "event_id",
        F.unhex(packed(8, {0: field(480 + K(), 2), 4: field(30000 + F.floor(V()) - 500, 2), 6: field(K() * 10, 2)})).alias("f90"),
        F.unhex(packed(8, {0: field(E() % 3, 1), 1: field(F.col("switches")["charge"].cast("int"), 1), 4: field(E() * 7, 4)})).alias("f93"),
        F.unhex(packed(8, {0: field(4, 1), 1: field(7, 1), 4: field(E() % 16, 1), 5: field(E() % 30, 2)})).alias("f94"),
        F.unhex(packed(8, {0: field(1, 1), 1: field(c[0], 2), 3: field(c[1], 2), 5: field(c[2], 2)})).alias("f95"),
        F.unhex(packed(8, {0: field(1, 1), **{1 + i: field(K() + i, 1) for i in range(7)}})).alias("f96"),
    )
    d = {k: B.decode(F.col(f"f{k}"), B.LAYOUTS[f"daly_{k}"]) for k in ("90", "93", "94", "95", "96")}
    join = lambda a: F.array_join(a.cast("array<string>"), ",")
    # the probe byte is signed: 88 degrees and more do not occur in the test data
    return df.select(
        "event_id", r6(d["90"]["voltage"]).alias("voltage"), r6(d["90"]["current"]).alias("current"), r6(d["90"]["soc"]).alias("soc"),
        mode_label(d["93"]["mode"]).alias("mode"), d["93"]["charging_mosfet"].alias("charging_mosfet"), r6(d["93"]["charge"]).alias("charge"),
        d["94"]["num_cycles"].alias("num_cycles"), bits(d["94"]["io_states"].cast("int"), IO_NAMES)["DI2"].alias("di2"),
        join(d["95"]["cell_mv"]).alias("cells"), join(d["96"]["temperatures"]).alias("temps"),
    )


@query(
    "daly_cell_parts",
    f"""WITH {TEL} SELECT event_id, device, CASE WHEN event_id % 5 <> 0 THEN array_to_string(cell_mv, ',') END AS cells FROM tel""",
)
def daly_cell_parts(spark, sf_dir):
    """Four cells come in two parts of three slots; every fifth poll has a wrong part number."""
    c = [F.get("cell_mv", F.lit(i)) for i in range(4)]
    first = packed(8, {0: field(1, 1), 1: field(c[0], 2), 3: field(c[1], 2), 5: field(c[2], 2)})
    second = packed(8, {0: field(F.when(E() % 5 == 0, 3).otherwise(2), 1), 1: field(c[3], 2)})
    df = samples(spark, sf_dir).select("event_id", "device", F.explode(F.array(F.unhex(second), F.unhex(first))).alias("frame"), F.lit(4).alias("n_cells"))
    df = R.join_numbered(R.decode_frames(df, "daly_95"), "cell_mv", "cell_mv", ("event_id", "device"), count="n_cells")
    return df.select("event_id", "device", F.array_join(F.col("cell_mv").cast("array<string>"), ",").alias("cells"))


@query(
    "decode_daly2",
    f"""WITH {TEL} SELECT event_id, round((480 + k) / 10.0::DOUBLE, 6) AS voltage, round((floor(value) - 500) / 10.0::DOUBLE, 6) + 0.0 AS current, round(k / 10.0::DOUBLE, 6) AS soc, event_id % 3 AS n_temps, k - 40 AS first_temp, array_to_string(cell_mv, ',') AS cells,
 CASE WHEN event_id % 2 = 0 THEN '18446744073709551615' ELSE CAST(event_id AS VARCHAR) END AS problem_code FROM tel""",
)
def decode_daly2(spark, sf_dir):
    """The alarm mask has 64 bits and can exceed a signed long."""
    code = F.when(E() % 2 == 0, F.lit("F" * 16)).otherwise(hex_int(E(), 8))
    parts = {0: literal("D2037C"), 83: field(480 + K(), 2), 85: field(30000 + F.floor(V()) - 500, 2), 87: field(K(), 2), 101: field(4, 2), 103: field(E() % 3 , 2), 67: field(K(), 2), 69: field(K() + 1, 2), 119: (code, 8, None)}
    parts |= {3 + 2 * i: field(F.get("cell_mv", F.lit(i)), 2) for i in range(4)}
    df = R.decode_frames(samples(spark, sf_dir).select("event_id", "k", F.unhex(packed(129, parts)).alias("frame")), "daly2")
    return df.select(
        "event_id", *[r6(c).alias(c) for c in ("voltage", "current", "soc")], F.size("temperatures").alias("n_temps"),
        F.coalesce(F.get("temperatures", F.lit(0)), F.col("k") - 40).cast("int").alias("first_temp"),
        F.array_join(F.col("cell_mv").cast("array<string>"), ",").alias("cells"), F.col("problem_code").cast("string").alias("problem_code"),
    )


def jk_status_frame(kind: str) -> Column:
    s = 32 if kind == "32s" else 0
    le = lambda v, n: field(v, n, "little")
    parts = {0: literal("55AAEB9002"), 118 + s: le(48000 + 50 * K(), 4), 126 + s: le(F.floor((50 - V()) * 100), 4), 130 + s: le(K() * 10 - 300, 2), 132 + s: le(F.when(E() % 4 == 0, -2000).otherwise(250), 2),
             138 + s: le(E() % 100 - 50, 2), 141 + s: field(K(), 1), 142 + s: le(K() * 1000, 4), 150 + s: le(E() % 500, 4), 154 + s: le(E() * 3, 4), 162 + s: le(E() * 60, 4)}
    if kind == "32s":
        parts |= {144: le(F.floor(V()) + 100, 2), 178: le(95000, 4), 190: field(97, 1), 256: le(K() - 50, 2), 258: le(-2000, 2)}
    else:
        parts |= {134: le(F.floor(V()) + 100, 2)}
    parts |= {6 + 2 * i: le(F.get("cell_mv", F.lit(i)), 2) for i in range(4)}
    return F.concat(packed(299, parts), hex_int(sum_of(parts), 1))


JK_SQL = """event_id, round((48000 + 50 * k) / 1000.0::DOUBLE, 6) AS voltage, round(-floor((50 - value) * 100) / 1000.0::DOUBLE, 6) + 0.0 AS current, k::DOUBLE AS charge, event_id % 500 AS num_cycles, event_id * 60 AS uptime, round(event_id * 3 / 1000.0::DOUBLE, 6) AS total_charge_throughput,
 round((k * 10 - 300) / 10.0::DOUBLE, 6) + 0.0 AS temperature_0, CASE WHEN event_id % 4 <> 0 THEN 25.0::DOUBLE END AS temperature_1, round((floor(value) + 100) / 10.0::DOUBLE, 6) AS mos_temperature, round((event_id % 100 - 50) / 1000.0::DOUBLE, 6) + 0.0 AS balance_current, array_to_string(cell_mv, ',') AS cells"""


@query(
    "decode_jk",
    f"""WITH {TEL} SELECT {JK_SQL}, 'jk 24s' AS kind, NULL::DOUBLE AS soh, round(CASE WHEN k > 0 THEN round_even(k / 275.0::DOUBLE * 100, 2) ELSE k END, 6) AS soc FROM tel
UNION ALL SELECT {JK_SQL}, 'jk 32s', 97.0::DOUBLE, round(CASE WHEN k > 0 THEN round_even(k / 95.0::DOUBLE * 100, 2) ELSE k END, 6) FROM tel""",
)
def decode_jk(spark, sf_dir):
    """Both firmware layouts, joined with the settings frame of the device for the configured capacity."""
    settings_text = packed(300, {0: literal("55AAEB9001"), 118: field(1, 1), 122: field(1, 1), 130: field(275000, 4, "little")})
    df = samples(spark, sf_dir).withColumn("settings", F.unhex(settings_text))
    out = []
    for kind in ("24s", "32s"):
        part = R.decode_frames(df.select("event_id", "settings", F.unhex(jk_status_frame(kind)).alias("frame")), f"jk_status_{kind}")
        part = part.withColumn("capacity", B.decode(F.col("settings"), B.LAYOUTS["jk_settings"])["capacity"])
        part = R.jk_soc(part, "aged_capacity" if kind == "32s" else None)
        out.append(
            part.select(
                "event_id", *[r6(c).alias(c) for c in ("voltage", "current", "charge", "total_charge_throughput", "mos_temperature", "balance_current", "soc")],
                "num_cycles", "uptime", r6(F.get("temperatures", F.lit(0))).alias("temperature_0"), r6(F.get("temperatures", F.lit(1))).alias("temperature_1"),
                F.array_join(F.slice("cell_mv", 1, 4).cast("array<string>"), ",").alias("cells"), F.lit(f"jk {kind}").alias("kind"),
                (F.col("soh").cast("double") if kind == "32s" else F.lit(None).cast("double")).alias("soh"),
            )
        )
    return out[0].unionByName(out[1])


@query(
    "decode_jk_settings",
    f"""WITH {TEL} SELECT event_id, (200000 + k) / 1000.0::DOUBLE AS capacity, event_id % 2 = 1 AS switch_charge, event_id % 3 = 0 AS switch_discharge, event_id % 5 = 0 AS switch_balance, event_id % 7 = 0 AS switch_float_charge FROM tel""",
)
def decode_jk_settings(spark, sf_dir):
    """The configured capacity and all four switches of a settings frame, the last one a bit of a byte that holds others."""
    on = lambda c: F.when(c, 1).otherwise(0)
    parts = {0: literal("55AAEB9001"), 118: field(E() % 2, 1), 122: field(on(E() % 3 == 0), 1), 126: field(on(E() % 5 == 0), 1), 130: field(200000 + K(), 4, "little"), 283: field(on(E() % 7 == 0) * 2 + E() % 2 + 4, 1)}
    df = samples(spark, sf_dir).select("event_id", F.unhex(packed(300, parts)).alias("frame"))
    got = B.decode(F.col("frame"), B.LAYOUTS["jk_settings"])
    return df.select("event_id", *[got[c].alias(c) for c in ("capacity", "switch_charge", "switch_discharge", "switch_balance", "switch_float_charge")])


@query(
    "decode_litime",
    f"""WITH {TEL} SELECT event_id, round((48000 + 50 * k) / 1000.0::DOUBLE, 6) AS voltage, round(-floor((50 - value) * 100) / 1000.0::DOUBLE, 6) + 0.0 AS current, k::DOUBLE AS charge, 105.0::DOUBLE AS capacity, k AS soc, k - 20 AS temperature,
 array_to_string(list_filter(list_transform(cell_mv, lambda x: CASE WHEN x % 6 = 0 THEN 0 ELSE x END), lambda x: x <> 0), ',') AS cells FROM tel""",
)
def decode_litime(spark, sf_dir):
    le = lambda v, n: field(v, n, "little")
    cell = lambda i: F.when(F.get("cell_mv", F.lit(i)) % 6 == 0, 0).otherwise(F.get("cell_mv", F.lit(i)))
    parts = {12: le(48000 + 50 * K(), 4), 48: le(F.floor((50 - V()) * 100), 4), 52: le(K() - 20, 2), 54: le(22, 2), 62: le(100 * K(), 2), 64: le(10500, 2), 90: le(K(), 2), 96: le(3, 4), 100: le(351, 4)}
    parts |= {16 + 4 * i: le(cell(i), 2) for i in range(4)}
    df = R.decode_frames(samples(spark, sf_dir).select("event_id", F.unhex(packed(105, parts)).alias("frame")), "litime")
    return df.select("event_id", *[r6(c).alias(c) for c in ("voltage", "current", "charge", "capacity")], "soc", F.get("temperatures", F.lit(0)).alias("temperature"),
                     F.array_join(F.col("cell_mv").cast("array<string>"), ",").alias("cells"))


def modbus_capacity_frame() -> Column:
    parts = {0: literal("010332"), 3: field(F.when(E() % 5 == 0, 0).otherwise(400 + K()), 2), 27: field(F.when(V() > 50, 0).otherwise(F.floor(V())), 2), 29: field(F.when(V() > 50, F.floor(V())).otherwise(0), 2),
             31: field(K(), 2), 33: field(98, 2), 35: field(10 * K(), 2), 37: field(980, 2), 39: field(1000, 2), 41: field(E() % 700, 2)}
    body = packed(53, parts)
    return F.concat(body, hex_int(B.crc16_modbus(F.unhex(body)), 2, "little"))


@query(
    "decode_modbus",
    f"""WITH {TEL} SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN round(k / 10.0::DOUBLE, 6) END AS temperature, round(CASE WHEN value > 50 THEN floor(value) / 10.0::DOUBLE ELSE -floor(value) / 10.0::DOUBLE END, 6) + 0.0 AS current, k AS soc, 98 AS soh, k::DOUBLE AS charge,
 98.0::DOUBLE AS aged_capacity, 100.0::DOUBLE AS capacity, event_id % 700 AS num_cycles, true AS ok, array_to_string(list_filter(cell_mv, lambda x: x % 6 <> 0), ',') AS cells,
 array_to_string(list_transform(cell_mv[1:event_id % 4 + 1], lambda x: CASE WHEN x % 6 = 0 THEN 61001 ELSE x END), ',') AS known_cells FROM tel""",
)
def decode_modbus(spark, sf_dir):
    from fleetwatt.functions.scalar import net_current

    cell = lambda i: F.when(F.get("cell_mv", F.lit(i)) % 6 == 0, 0xEE49).otherwise(F.get("cell_mv", F.lit(i)))
    volts = packed(81, {0: literal("01034C"), **{3 + 2 * i: field(cell(i), 2) for i in range(4)}, 77: field(1448, 2)})
    df = samples(spark, sf_dir).select("event_id", F.unhex(modbus_capacity_frame()).alias("cap"), F.unhex(volts).alias("frame"), (E() % 4 + 1).cast("int").alias("n_cells"))
    df = R.frame_valid(R.decode_frames(df, "modbus_capacity", "cap"), "modbus", "cap")
    cells = B.decode(F.col("frame"), B.LAYOUTS["modbus_volts"])["cell_mv"]
    df = R.modbus_cells(df.withColumns({"cells": cells, "known_cells": cells}), cells="known_cells")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return df.select("event_id", r6("temperature").alias("temperature"), r6(net_current(F.col("charge_a"), F.col("discharge_a"))).alias("current"), "soc", "soh",
                     *[r6(c).alias(c) for c in ("charge", "aged_capacity", "capacity")], "num_cycles", "ok", text("cells"), text("known_cells"))


@query(
    "decode_basen",
    f"""WITH {TEL} SELECT event_id, round((48000 + 50 * k) / 1000.0::DOUBLE, 6) AS voltage, round(-floor((50 - value) * 100) / 1000.0::DOUBLE, 6) + 0.0 AS current, k::DOUBLE AS charge, k AS soc, array_to_string([k, k - 60, 25, -1], ',') AS temps, true AS ok,
 CAST((CASE WHEN event_id % 3 = 0 THEN 5 ELSE 0 END) | (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END << 16) AS BIGINT) AS problem_code FROM tel""",
)
def decode_basen(spark, sf_dir):
    from fleetwatt.functions.scalar import alarm_code_states

    le = lambda v, n: field(v, n, "little")
    states = F.when(E() % 3 == 0, 0x85).otherwise(0x80)
    warn = F.when(E() % 2 == 0, 0x11).otherwise(0x10)
    parts = {0: literal("3B162A18"), 4: le(F.floor((50 - V()) * 100), 4), 8: le(48000 + 50 * K(), 4), 12: field(K(), 1), 13: field(K() - 60, 1), 14: field(25, 1), 15: field(-1, 1), 16: le(1000 * K(), 4), 20: field(states, 1), 21: field(0x80, 1), 22: field(warn, 1), 24: field(K(), 1)}
    body, check = packed(28, parts), hex_int(sum_of(parts) - 0x3B, 2, "little")
    df = samples(spark, sf_dir).select("event_id", F.unhex(F.concat(body, check, F.lit("0D0A"))).alias("frame"))
    df = R.frame_valid(R.decode_frames(df, "basen_status"), "basen")
    code = alarm_code_states(*[F.col(c).cast("int") for c in ("charge_states", "discharge_states", "charge_warn", "discharge_warn")])
    return df.select("event_id", *[r6(c).alias(c) for c in ("voltage", "current", "charge")], "soc", F.array_join(F.col("temperatures").cast("array<string>"), ",").alias("temps"), "ok", code.cast("long").alias("problem_code"))


@query(
    "decode_modbus_info",
    f"""WITH {TEL} SELECT event_id, CAST(event_id % 33 AS BIGINT) AS n_cells, CAST(k % 9 AS BIGINT) AS n_temps, true AS ok FROM tel""",
)
def decode_modbus_info(spark, sf_dir):
    body = packed(7, {0: literal("010304"), 3: field(E() % 33, 2), 5: field(K() % 9, 2)})
    df = samples(spark, sf_dir).select("event_id", F.unhex(F.concat(body, hex_int(B.crc16_modbus(F.unhex(body)), 2, "little"))).alias("frame"))
    df = R.frame_valid(R.decode_frames(df, "modbus_info"), "modbus")
    return df.select("event_id", F.col("n_cells").cast("long").alias("n_cells"), F.col("n_temps").cast("long").alias("n_temps"), "ok")


@query(
    "decode_basen_info",
    f"""WITH {TEL} SELECT event_id, round((90000 + k) / 1000.0::DOUBLE, 6) AS capacity, round(51200 / 1000.0::DOUBLE, 6) AS nominal_voltage, round((80000 + 10 * k) / 1000.0::DOUBLE, 6) AS aged_capacity, CAST(event_id % 5000 AS BIGINT) AS num_cycles FROM tel""",
)
def decode_basen_info(spark, sf_dir):
    le = lambda v, n: field(v, n, "little")
    frame = packed(32, {0: literal("3B162B1C"), 4: le(90000 + K(), 4), 8: le(51200, 4), 12: le(80000 + 10 * K(), 4), 26: le(E() % 5000, 2)})
    df = R.decode_frames(samples(spark, sf_dir).select("event_id", F.unhex(frame).alias("frame")), "basen_info")
    return df.select("event_id", *[r6(c).alias(c) for c in ("capacity", "nominal_voltage", "aged_capacity")], F.col("num_cycles").cast("long").alias("num_cycles"))


@query(
    "decode_basen_cells",
    f"""WITH {TEL} SELECT event_id, array_to_string(list_transform(range(CASE WHEN event_id % 3 = 0 THEN 100 ELSE 4 END), lambda i: 3300 + (k + i) % 100), ',') AS cells FROM tel""",
)
def decode_basen_cells(spark, sf_dir):
    """Every third frame declares 100 cells; as many come out."""
    n = F.when(E() % 3 == 0, 100).otherwise(4)
    one = lambda i: hex_int(3300 + (K() + i) % 100, 2, "little")
    cells = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), one), "")
    frame = F.concat(F.lit("3B1624"), hex_int(2 * n, 1), cells, F.lit("00000D0A"))
    df = R.decode_frames(samples(spark, sf_dir).select("event_id", F.unhex(frame).alias("frame")), "basen_cells")
    return df.select("event_id", F.array_join(F.col("cell_mv").cast("array<string>"), ",").alias("cells"))


@query(
    "decode_meter",
    f"""WITH {TEL}, m AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (3000 + k) / 10.0::DOUBLE ELSE k / 10.0::DOUBLE END AS v, floor(value) / 1000.0::DOUBLE AS i, event_id / 1000.0::DOUBLE AS q, k / 100.0::DOUBLE AS e FROM tel)
SELECT event_id, round(v, 6) AS voltage, round(i, 6) AS current, round(q, 6) AS charge, round(e, 6) AS energy, 59 AS temperature, round_even(v * i, 0) + 0.0 AS power, i > 0 AS battery_charging FROM m""",
)
def decode_meter(spark, sf_dir):
    compact = packed(36, {0: literal("FF550102"), 4: field(3000 + K(), 2), 6: field(F.floor(V()), 2), 8: field(E(), 3), 11: field(K(), 4), 24: field(59, 2)})
    padded = packed(36, {0: literal("FF550102"), 4: field(K(), 3), 7: field(F.floor(V()), 3), 10: field(E(), 3), 13: field(K(), 4), 24: field(59, 2)})
    df = samples(spark, sf_dir).select("event_id", F.unhex(F.when(E() % 2 == 0, compact).otherwise(padded)).alias("frame"))
    out = R.decode_meter(df)
    return out.select("event_id", *[r6(c).alias(c) for c in ("voltage", "current", "charge", "energy", "power")], "temperature", "battery_charging")


@query(
    "frame_valid",
    f"""WITH {TEL} SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'checksum' WHEN 1 THEN 'length' WHEN 2 THEN 'header' WHEN 3 THEN 'status' WHEN 4 THEN 'terminator' WHEN 5 THEN 'short' END AS reason, event_id % 8 IN (6, 7) AS ok,
 CASE event_id % 4 WHEN 0 THEN 'checksum' WHEN 1 THEN 'type' WHEN 2 THEN 'short' END AS jk_reason, CASE event_id % 3 WHEN 0 THEN 'checksum' WHEN 1 THEN 'length' END AS modbus_reason, CASE event_id % 3 WHEN 0 THEN 'header' WHEN 1 THEN 'checksum' END AS daly_reason FROM tel""",
)
def frame_valid(spark, sf_dir):
    m = E() % 8
    good = F.col("good")
    n = 68
    jbd = (
        F.when(m == 0, F.concat(F.substring(good, 1, 10), F.lit("FFFF"), F.substring(good, 15, n)))
        .when(m == 1, F.concat(F.substring(good, 1, n - 4), F.lit("77")))
        .when(m == 2, F.concat(F.lit("DC"), F.substring(good, 3, n)))
        .when(m == 3, F.concat(F.lit("DD0380"), F.substring(good, 7, n)))
        .when(m == 4, F.concat(F.substring(good, 1, n - 2), F.lit("78")))
        .when(m == 5, F.substring(good, 1, 10))
        .otherwise(good)
    )
    jk = F.col("jk")
    other = {0: literal("55AAEB9007")}
    jk = F.when(E() % 4 == 0, F.concat(F.substring(jk, 1, 598), off_by_one(F.substring(jk, 599, 2)))).when(E() % 4 == 1, F.concat(packed(299, other), hex_int(sum_of(other), 1))).when(E() % 4 == 2, F.substring(jk, 1, 590)).otherwise(jk)
    reply = "0103080004000100060005"
    mod = F.when(E() % 3 == 0, F.lit(reply + "CDD4")).when(E() % 3 == 1, F.lit(reply)).otherwise(F.lit(reply + "CDD5"))
    parts = {0: literal("A501"), 4: field(K(), 2)}
    text, total = packed(12, parts), hex_int(sum_of(parts), 1)
    daly = F.when(E() % 3 == 0, F.concat(F.lit("A4"), F.substring(text, 3, 30), F.lit("00"))).when(E() % 3 == 1, F.concat(text, off_by_one(total))).otherwise(F.concat(text, total))
    df = samples(spark, sf_dir).select("event_id", "k", jbd_info_frame().alias("good"), jk_status_frame("24s").alias("jk"))
    df = df.select("event_id", F.unhex(jbd).alias("frame"), F.unhex(jk).alias("jk"), F.unhex(mod).alias("mod"), F.unhex(daly).alias("daly"))
    df = R.frame_valid(df, "jbd")
    return df.select("event_id", "reason", "ok", B.invalid_jk(F.col("jk")).alias("jk_reason"), B.invalid_modbus(F.col("mod")).alias("modbus_reason"), B.invalid_daly(F.col("daly")).alias("daly_reason"))


@query(
    "reassemble",
    f"""WITH {TEL}, l AS (SELECT event_id, device, lag(event_id) OVER w AS pe, lag(k) OVER w AS pk FROM tel WINDOW w AS (PARTITION BY device ORDER BY ts, event_id))
SELECT event_id, device, CASE WHEN pe % 10 = 3 OR pe IS NULL THEN 0 ELSE 1 END AS n_frames, CASE WHEN event_id % 6 = 0 THEN 4 ELSE 0 END AS junk_bytes, CASE WHEN pe % 10 = 3 THEN 1 ELSE 0 END AS corrupt,
 CASE WHEN pe % 10 <> 3 THEN pe % 1000 END AS num_cycles, CASE WHEN pe % 10 <> 3 THEN pk END AS soc FROM l""",
)
def reassemble(spark, sf_dir):
    """Every packet holds the tail of the previous frame, sometimes junk, and the head of the next frame."""
    return told(R.reassemble(packets(spark, sf_dir), "jbd"))


def packets(spark, sf_dir):
    """(device, ts, seq, chunk): frames cut anew, as they come over the air."""
    good = F.col("good")
    text = F.when(E() % 10 == 3, F.concat(F.substring(good, 1, 64), off_by_one(F.substring(good, 65, 2)), F.lit("77"))).otherwise(good)
    base = samples(spark, sf_dir).withColumn("good", jbd_info_frame())
    df = prefix.scan(base.withColumn("f", text).select("event_id", "device", "ts", "f"), lag={"p": F.col("f")})
    junk = F.when(E() % 6 == 0, F.lit("41540D0A")).otherwise(F.lit(""))
    chunk = F.concat(F.coalesce(F.substring(F.col("p"), 49, 20), F.lit("")), junk, F.substring(F.col("f"), 1, 48))
    return df.select("device", "ts", E().alias("seq"), F.unhex(chunk).alias("chunk"))


def told(out):
    """What the frames that a chunk completed say."""
    info = B.decode(F.get("frames", F.lit(0)), B.LAYOUTS["jbd_info"])
    return out.select(F.col("seq").alias("event_id"), "device", F.size("frames").alias("n_frames"), "junk_bytes", "corrupt", info["num_cycles"].alias("num_cycles"), info["soc"].alias("soc"))


@query(
    "bit_diff",
    """WITH f AS (SELECT event_type AS l, ((event_id % 32) * 3 | CASE event_type WHEN 'view' THEN 5570560 WHEN 'click' THEN 13566720 ELSE 0 END) AS w FROM events WHERE event_type IN ('view', 'click')),
b AS (SELECT l, i, (w >> i) & 1 AS v FROM f, range(48) r(i)), s AS (SELECT l, i, min(v) AS lo, max(v) AS hi FROM b GROUP BY l, i)
SELECT CAST(a.i AS INTEGER) AS bit, CAST(a.lo AS INTEGER) AS in_a, CAST(z.lo AS INTEGER) AS in_b FROM s a JOIN s z ON a.i = z.i AND a.l = 'view' AND z.l = 'click' WHERE a.lo = a.hi AND z.lo = z.hi AND a.lo <> z.lo""",
)
def bit_diff(spark, sf_dir):
    mark = F.when(F.col("event_type") == "view", 5570560).when(F.col("event_type") == "click", 13566720).otherwise(0)
    word = ((E() % 32) * 3).bitwiseOR(mark.cast("long"))
    df = samples(spark, sf_dir).select(F.col("event_type").alias("label"), F.unhex(hex_int(word, 6, "little")).alias("frame"))
    return R.bit_diff(df, 6, a="view", b="click")


class Streak(Fold):
    """Example of a user algorithm: how many samples in a row were above a level."""

    inputs = ("x",)
    output = "streak int"

    def __init__(self, level: str):
        self.level = float(level)

    def init(self):
        return 0

    def step(self, state, row):
        (x,) = row
        state = state + 1 if x is not None and x > self.level else 0
        return state, (state,)


algorithms.register_algorithm("streak", Streak)


@query(
    "user_algorithm",
    f"""WITH {TEL}, s AS (SELECT event_id, device, ts, current > 0 AS up, sum(CASE WHEN current > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM tel)
SELECT event_id, device, CASE WHEN up THEN CAST(sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY device, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) ELSE 0 END AS streak FROM s""",
)
def user_algorithm(spark, sf_dir):
    df = samples(spark, sf_dir).select("event_id", "device", "ts", "current")
    return algorithms.run_algorithm(df, "streak 0", {"x": F.col("current")}).select("event_id", "device", "streak")
