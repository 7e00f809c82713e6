"""Sink queries: the tables that would be written, over the telemetry view."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwatt.functions.scalar import flatten_columns
from fleetwatt.operators import meters as M
from fleetwatt.operators.prefix import in_runs
from fleetwatt.plans.energy import GAP_S, INC, metered, powered
from fleetwatt.plans.joined import device_table
from fleetwatt.plans.registry import query, r6
from fleetwatt.plans.scalars import CELL_STATS_SQL
from fleetwatt.plans.telemetry import TEL, samples
from fleetwatt.schema import ENTITIES, METER_ENTITIES
from fleetwatt.sinks import points as P


@query(
    "changed_points",
    f"""WITH {TEL}, f AS (SELECT event_id, device, ts, t_us, round_even(voltage * 7 / 3, 3) AS voltage, CAST(CAST(soc / 10 AS INTEGER) AS DOUBLE) AS level, CASE WHEN sw_charge THEN 1.0::DOUBLE ELSE 0.0 END AS charge_on, CASE WHEN event_type <> 'view' THEN event_type END AS mode FROM tel),
l AS (SELECT *, lag(voltage) OVER w AS pv, lag(level) OVER w AS pl, lag(charge_on) OVER w AS pc, lag(mode) OVER w AS pm FROM f WINDOW w AS (PARTITION BY device ORDER BY ts, event_id)),
c AS (SELECT event_id, device, CAST(ceil(t_us / 1000.0::DOUBLE) AS BIGINT) AS time_ms, CASE WHEN voltage IS DISTINCT FROM pv THEN voltage END AS voltage, CASE WHEN level IS DISTINCT FROM pl THEN level END AS level, CASE WHEN charge_on IS DISTINCT FROM pc THEN charge_on END AS charge_on, CASE WHEN mode IS DISTINCT FROM pm THEN mode END AS mode FROM l)
SELECT * FROM c WHERE voltage IS NOT NULL OR level IS NOT NULL OR charge_on IS NOT NULL OR mode IS NOT NULL""",
)
def changed_points(spark, sf_dir):
    df = samples(spark, sf_dir).select(
        "event_id", "device", "ts", (F.col("voltage") * 7 / 3).alias("voltage"), F.bround(F.col("soc") / 10).cast("int").alias("level"),
        F.col("switches")["charge"].alias("charge_on"), F.when(F.col("event_type") != "view", F.col("event_type")).otherwise("").alias("mode"),
    )
    return P.changed_points(df, ("voltage", "level", "charge_on", "mode")).drop("ts")


CELL_POINTS_SQL = f"""{TEL}, q AS (SELECT event_id, device, ts, list_transform(cell_mv, lambda x: CASE WHEN x % 11 = 0 THEN NULL ELSE x // 200 * 200 END) AS c FROM tel),
l AS (SELECT *, """ + ", ".join(
    f"last_value(c[{i + 1}] IGNORE NULLS) OVER w AS p{i}" for i in range(4)
) + """ FROM q WINDOW w AS (PARTITION BY device ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
w AS (SELECT event_id, device, """ + ", ".join(f"CASE WHEN c[{i + 1}] IS DISTINCT FROM p{i} THEN c[{i + 1}] END AS voltage_cell00{i}" for i in range(4)) + """,
 list_max(c) AS voltage_cell_max, list_min(c) AS voltage_cell_min, round(list_avg(c), 6) + 0.0 AS voltage_cell_mean, round(list_median(c), 6) + 0.0 AS voltage_cell_median FROM l)"""


def _cells(spark, sf_dir):
    coarse = F.transform("cell_mv", lambda x: F.when(x % 11 != 0, F.floor(x / 200).cast("int") * 200))
    return P.cell_points(samples(spark, sf_dir).select("event_id", "device", "ts", coarse.alias("cell_mv")), 4)


@query("cell_points", f"WITH {CELL_POINTS_SQL} SELECT * FROM w")
def cell_points(spark, sf_dir):
    out = _cells(spark, sf_dir).drop("ts", "cell_mv")
    return out.withColumns({c: r6(c) for c in ("voltage_cell_mean", "voltage_cell_median")})


@query(
    "changed_cells",
    f"""WITH {CELL_POINTS_SQL}, u AS (SELECT event_id, device, unnest([0, 1, 2, 3]) AS cell_index, unnest([voltage_cell000, voltage_cell001, voltage_cell002, voltage_cell003]) AS voltage FROM w)
SELECT * FROM u WHERE voltage IS NOT NULL""",
)
def changed_cells(spark, sf_dir):
    coarse = F.transform("cell_mv", lambda x: F.when(x % 11 != 0, F.floor(x / 200).cast("int") * 200))
    return P.changed_cells(samples(spark, sf_dir).select("event_id", "device", "ts", coarse.alias("cell_mv")), ("event_id", "device"))


@query(
    "changed_cells_layout",
    f"""WITH {TEL}, q AS (SELECT event_id, device, ts, CASE WHEN event_id % 7 = 0 THEN list_transform(range(40), lambda i: (3300 + i % 3)::INTEGER) ELSE list_transform(range(38), lambda i: (3300 + i % 2)::INTEGER) END AS c FROM tel),
z AS (SELECT *, lag(len(c)) OVER (PARTITION BY device ORDER BY ts, event_id) AS before FROM q),
y AS (SELECT *, sum(CASE WHEN before <> len(c) THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS layout FROM z),
u AS (SELECT event_id, device, ts, layout, unnest(range(len(c)))::INTEGER AS cell_index, unnest(c) AS voltage FROM y),
l AS (SELECT *, lag(voltage) OVER (PARTITION BY device, layout, cell_index ORDER BY ts, event_id) AS old FROM u)
SELECT event_id, device, cell_index, voltage FROM l WHERE voltage IS DISTINCT FROM old""",
)
def changed_cells_layout(spark, sf_dir):
    """Packs of 40 and 38 cells by turns: every cell is written, and all again when their number changes."""
    pattern = lambda n, m: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (3300 + i % m).cast("int"))
    cells = F.when(F.col("event_id") % 7 == 0, pattern(40, 3)).otherwise(pattern(38, 2))
    return P.changed_cells(samples(spark, sf_dir).select("event_id", "device", "ts", cells.alias("cell_mv")), ("event_id", "device"))


def _flat(spark, sf_dir):
    df = powered(spark, sf_dir).withColumn("temperatures", F.array("mos_temperature", F.col("k") / 3.0)).withColumn("problem", F.col("problem_code") != 0)
    cols = flatten_columns(
        ("event_id", "device", "ts", "voltage", "current", "power", "soc", "charge", "capacity", "mos_temperature", "problem_code", "problem", "cell_mv", "event_type"),
        ("charge", "discharge"), 2,
    )
    return df.select(*cols)


ENC_SQL = """CAST(round_even(voltage * 1000, 0) AS INTEGER) AS voltage, CAST(round_even(current * 1000, 0) AS INTEGER) AS current, CAST(round_even(soc * 100, 0) AS INTEGER) AS soc, CAST(round_even(capacity * 100, 0) AS INTEGER) AS capacity,
 CAST(round_even(mos_temperature * 100, 0) AS INTEGER) AS mos_temperature, CAST(round_even(mos_temperature * 100, 0) AS INTEGER) AS temperatures_0, CAST(round_even(k / 3.0::DOUBLE * 100, 0) AS INTEGER) AS temperatures_1,
 problem_code, sw_charge AS switches_charge, sw_discharge AS switches_discharge, round_even(voltage * current, 3) AS power, charge, CASE WHEN problem_code <> 0 THEN 1.0::DOUBLE ELSE 0.0 END AS problem"""


@query(
    "fixed_point_encode",
    f"""WITH {TEL} SELECT event_id, device, {ENC_SQL.replace("round_even(voltage * current, 3)", "round(CAST(round_even(voltage * current, 3) AS FLOAT)::DOUBLE, 4) + 0.0")}, cell_mv[1] AS voltage_cell000, cell_mv[4] AS voltage_cell003, CAST(NULL AS INTEGER) AS voltage_cell031, CAST(greatest(len(cell_mv) - 32, 0) AS INTEGER) AS cells_left_out FROM tel""",
)
def fixed_point_encode(spark, sf_dir):
    enc = P.encode_fixed_point(_flat(spark, sf_dir), ("event_id", "device"))
    unused = [f"voltage_cell{i:03d}" for i in range(32) if i not in (0, 3, 31)]
    power = F.round(F.col("power").cast("double") * 1e4, 0) / 1e4 + F.lit(0.0)
    return enc.drop(*unused).withColumns({"power": power, "charge": F.col("charge").cast("double"), "problem": F.col("problem").cast("double")})


@query(
    "fixed_point_roundtrip",
    f"""WITH {TEL}, e AS (SELECT event_id, device, voltage AS v0, current AS i0, {ENC_SQL} FROM tel)
SELECT event_id, device, round(voltage / 1000.0::DOUBLE, 6) + 0.0 AS voltage, round(current / 1000.0::DOUBLE, 6) + 0.0 AS current, round(soc / 100.0::DOUBLE, 6) + 0.0 AS soc, round(temperatures_1 / 100.0::DOUBLE, 6) + 0.0 AS temperatures_1,
       abs(voltage / 1000.0::DOUBLE - v0) <= 0.000501 AND abs(current / 1000.0::DOUBLE - i0) <= 0.000501 AS within_half_step FROM e""",
)
def fixed_point_roundtrip(spark, sf_dir):
    flat = _flat(spark, sf_dir).withColumns({"v0": F.col("voltage"), "i0": F.col("current")})
    dec = P.decode_fixed_point(P.encode_fixed_point(flat, ("event_id", "device", "v0", "i0")))
    ok = (F.abs(F.col("voltage") - F.col("v0")) <= 0.000501) & (F.abs(F.col("current") - F.col("i0")) <= 0.000501)
    return dec.select("event_id", "device", *[r6(c).alias(c) for c in ("voltage", "current", "soc", "temperatures_1")], ok.alias("within_half_step"))


@query(
    "export_anonymized",
    f"""WITH RECURSIVE {TEL}, d(device, slug, address) AS (VALUES ('bms0', 'jbd', 'C0:00:00'), ('bms1', 'jbd', 'C0:00:01'), ('bms3', 'jbd', 'C0:00:03')),
r AS (SELECT tel.*, slug, replace(translate(to_base64(unhex(regexp_replace(sha1(address), '(..)(..)', '\\2', 'g'))), '+/', '-_'), '=', '') AS addrh, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) AS rn FROM tel JOIN d USING (device)),
f AS (SELECT device, rn, t_us, t_us AS l, true AS kept FROM r WHERE rn = 1
  UNION ALL SELECT r.device, r.rn, r.t_us, CASE WHEN r.t_us - f.l >= 900000000 THEN r.t_us ELSE f.l END, r.t_us - f.l >= 900000000 FROM f JOIN r ON r.device = f.device AND r.rn = f.rn + 1)
SELECT event_id, slug || '_' || addrh AS device, slug, addrh, 'u1' AS uid, CAST(ceil(r.t_us / 1000.0::DOUBLE) AS BIGINT) AS time_ms, CAST(round_even(voltage * 1000, 0) AS INTEGER) AS voltage, CAST(round_even(current * 1000, 0) AS INTEGER) AS current, cell_mv[2] AS voltage_cell001
FROM f JOIN r ON r.device = f.device AND r.rn = f.rn WHERE kept""",
)
def export_anonymized(spark, sf_dir):
    """One sample per device in 15 minutes here; bms2 is a dummy and stays home."""
    devices = device_table(spark, sf_dir).select(
        "device", "address", F.when(F.col("device") == "bms2", "dummy").otherwise(F.col("type")).alias("type"), F.lit(False).alias("is_virtual")
    )
    out = P.export_anonymized(_flat(spark, sf_dir), devices, "u1", 900.0)
    return out.select("event_id", "device", "slug", "addrh", "uid", "time_ms", "voltage", "current", "voltage_cell001")


@query(
    "export_changes",
    f"""WITH RECURSIVE {TEL}, d(device, slug, address) AS (VALUES ('bms0', 'jbd', 'C0:00:00'), ('bms1', 'jbd', 'C0:00:01')),
r AS (SELECT tel.*, slug || '_' || replace(translate(to_base64(unhex(regexp_replace(sha1(address), '(..)(..)', '\\2', 'g'))), '+/', '-_'), '=', '') AS name, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) AS rn FROM tel JOIN d USING (device)),
f AS (SELECT device, rn, t_us, t_us AS l, true AS kept FROM r WHERE rn = 1
  UNION ALL SELECT r.device, r.rn, r.t_us, CASE WHEN r.t_us - f.l >= 900000000 THEN r.t_us ELSE f.l END, r.t_us - f.l >= 900000000 FROM f JOIN r ON r.device = f.device AND r.rn = f.rn + 1),
e AS (SELECT event_id, name, r.rn, r.device, CAST(round_even(floor(voltage / 2) * 1000, 0) AS INTEGER) AS v, CAST(round_even(floor(soc / 25) * 100, 0) AS INTEGER) AS s FROM f JOIN r ON r.device = f.device AND r.rn = f.rn WHERE kept),
c AS (SELECT event_id, name, CASE WHEN v IS DISTINCT FROM lag(v) OVER w THEN v END AS voltage, CASE WHEN s IS DISTINCT FROM lag(s) OVER w THEN s END AS soc FROM e WINDOW w AS (PARTITION BY device ORDER BY rn))
SELECT event_id, name AS device, replace(translate(to_base64(unhex(regexp_replace(sha1('disk-1'), '(..)(..)', '\\2', 'g'))), '+/', '-_'), '=', '') AS did, voltage, soc FROM c WHERE voltage IS NOT NULL OR soc IS NOT NULL""",
)
def export_changes(spark, sf_dir):
    """The export with fields that changed only and a machine tag; bms2 is a dummy and bms3 a virtual device, and both stay home."""
    devices = device_table(spark, sf_dir).select(
        "device", "address", F.when(F.col("device") == "bms2", "dummy").otherwise(F.col("type")).alias("type"), (F.col("device") == "bms3").alias("is_virtual")
    )
    flat = samples(spark, sf_dir).select("event_id", "device", "ts", F.floor(F.col("voltage") / 2).cast("double").alias("voltage"), F.floor(F.col("soc") / 25).cast("double").alias("soc"))
    return P.export_anonymized(flat, devices, "u1", 900.0, did="disk-1", changes=True).select("event_id", "device", "did", "voltage", "soc")


@query(
    "meter_points",
    f"""WITH {TEL}, {INC}, r AS (SELECT event_id, device, t_us, sum(d_net) OVER w AS e, sum(d_cyc) OVER w AS c FROM inc WINDOW w AS (PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT device, (t_us // 30000000) * 30 AS period, round_even(arg_max(e, event_id), 5) + 0.0 AS meter_total_energy, round_even(arg_max(c, event_id), 5) + 0.0 AS meter_total_cycles FROM r GROUP BY ALL""",
)
def meter_points(spark, sf_dir):
    readings = M.meter_readings(M.meter_increments(in_runs(metered(spark, sf_dir)), GAP_S))
    out = P.meter_points(readings, ("total_energy", "total_cycles"))
    return out.withColumns({c: F.col(c) + F.lit(0.0) for c in ("meter_total_energy", "meter_total_cycles")})


def _sig_sql(x: str, n: int) -> str:
    d = f"({n} - 1 - floor(log10(abs({x}))))"
    return f"CASE WHEN {x} = 0 THEN {x} WHEN {d} >= 0 THEN round_even({x} * pow(10, {d}), 0) / pow(10, {d}) ELSE round_even({x} / pow(10, -{d}), 0) * pow(10, -{d}) END"


@query(
    "entity_state",
    f"""WITH {TEL}, s AS (SELECT *, voltage * current AS power, cell_mv AS c FROM tel),
n AS (SELECT event_id, device, unnest(['soc/total_voltage', 'soc/current', 'soc/soc_percent', 'soc/power', 'soc/capacity', 'mosfet_status/capacity_ah', 'mosfet_status/temperature', 'temperatures/1', 'problem_code']) AS t,
  unnest([{_sig_sql('voltage', 4)}, {_sig_sql('current', 4)}, {_sig_sql('soc', 4)}, {_sig_sql('power', 4)}, {_sig_sql('capacity', 5)}, {_sig_sql('charge', 5)}, {_sig_sql('mos_temperature', 5)}, {_sig_sql('mos_temperature', 4)}, problem_code::DOUBLE]) AS value FROM s),
st AS (SELECT event_id, device, {CELL_STATS_SQL} FROM s), cs AS (SELECT event_id, device, unnest(['min', 'min_index', 'max', 'max_index', 'delta', 'average', 'median']) AS t, unnest([min, min_index, max, max_index, delta, average, median]) AS value FROM st),
cc AS (SELECT event_id, device, unnest([1, 2, 3, 4]) AS i, unnest(c) / 1000.0::DOUBLE AS value FROM s),
f AS (SELECT event_id, device, unnest(['switch/charge', 'switch/discharge', 'problem', 'battery_mode']) AS t, unnest([CASE WHEN sw_charge THEN 'ON' ELSE 'OFF' END, CASE WHEN sw_discharge THEN 'ON' ELSE 'OFF' END, CASE WHEN problem_code <> 0 THEN 'ON' ELSE 'OFF' END, CASE WHEN event_id % 2 = 0 THEN 'BULK' END]) AS state FROM s)
SELECT event_id, device, device || '/' || t AS topic, round(value, 6) + 0.0 AS value, NULL AS state FROM n
UNION ALL SELECT event_id, device, device || '/cell_voltages/' || t, round(value, 6) + 0.0, NULL FROM cs
UNION ALL SELECT event_id, device, device || '/cell_voltages/' || i, round(value, 6) + 0.0, NULL FROM cc
UNION ALL SELECT event_id, device, device || '/' || t, NULL, state FROM f WHERE state IS NOT NULL""",
)
def entity_state(spark, sf_dir):
    df = powered(spark, sf_dir).select(
        "event_id", "device", "voltage", "current", "soc", "power", "capacity", "charge", "mos_temperature", "switches", "problem_code", "cell_mv",
        (F.col("problem_code") != 0).alias("problem"), F.when(F.col("event_id") % 2 == 0, "BULK").alias("battery_mode"), F.array("mos_temperature").alias("temperatures"),
    )
    return P.entity_state(df, ("event_id", "device")).withColumn("value", r6("value"))


_CAT = [(t, f, u, c, s, p) for t, (f, u, c, s, p, _) in ENTITIES.items() if f in ("voltage", "current", "soc", "power", "capacity", "charge", "mos_temperature")]
_CAT += [(t, t.split("/")[1].replace("_", " "), u, c, s, p) for t, (u, c, s, p) in METER_ENTITIES.items()]
_CAT += [(f"cell_voltages/{i}", f"Cell Volt {i}", "V", "voltage", None, 3) for i in (1, 2, 3, 4)]
_CAT += [(f"cell_voltages/{s}", f"Cell Volt {s}", "V", "voltage", None, 3) for s in ("min", "max", "average", "median", "delta")]
_CAT += [(f"cell_voltages/{s}_index", f"Cell Index {s}", None, None, None, None) for s in ("min", "max")]
_CAT += [("switch/charge", "charge", None, "outlet", None, None), ("switch/discharge", "discharge", None, "outlet", None, None), ("problem_code", "problem code", None, None, None, None)]
_q = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"


@query(
    "entity_catalog",
    f"""WITH {TEL}, cat(topic, name, unit, device_class, state_class, precision) AS (VALUES {", ".join("(" + ", ".join(_q(v) for v in r) + ")" for r in _CAT)}),
t AS (SELECT device, count(CASE WHEN device <> 'bms1' THEN 1 END) > 0 AS has_temp FROM tel GROUP BY device)
SELECT device, cat.* FROM t, cat WHERE topic <> 'mosfet_status/temperature' OR has_temp
UNION ALL SELECT device, 'temperatures/1', 'Temperatures 1', '°C', 'temperature', NULL, 1 FROM t WHERE has_temp""",
)
def entity_catalog(spark, sf_dir):
    """bms1 has no temperature probe at all."""
    probe = F.when(F.col("device") != "bms1", F.col("mos_temperature"))
    df = powered(spark, sf_dir).select(
        "device", "voltage", "current", "soc", "power", "capacity", "charge", probe.alias("mos_temperature"), "switches", "problem_code", "cell_mv",
        F.when(probe.isNotNull(), F.array(probe)).alias("temperatures"), F.lit(None).cast("double").alias("soh"),
    )
    return P.entity_catalog(df)


_DISCOVERED = [("sensor", t, f.capitalize(), u, c, st, p, 20) for t, (f, u, c, st, p, _) in ENTITIES.items() if f in ("voltage", "current", "mos_temperature")]
_DISCOVERED += [("sensor", f"meter/{t}", n, u, c, st, 2, 7200) for t, n, u, c, st in (
    ("total_energy", "total energy netted", "kWh", "energy", None), ("total_energy_charge", "total energy input", "kWh", "energy", "total_increasing"), ("total_energy_discharge", "total energy output", "kWh", "energy", "total_increasing"),
    ("total_charge", "total charge netted", "Ah", None, None), ("total_cycles", "total cycle count", "N", None, None))]
_DISCOVERED += [("sensor", f"cell_voltages/{s}", f"Cell Volt {s}", "V", "voltage", None, 3, 20) for s in ("min", "max", "average", "median", "delta")]
_DISCOVERED += [("sensor", f"cell_voltages/{s}_index", f"Cell Index {s}", None, None, None, None, 20) for s in ("min", "max")]
_DISCOVERED += [(k, f"switch/{s}", s + more, None, c, None, None, 20) for s in ("charge", "discharge") for k, more, c in (("switch", "", "outlet"), ("binary_sensor", " switch", "power"))]


@query(
    "entity_discovery",
    f"""WITH {TEL}, d AS (SELECT DISTINCT device FROM tel), cat(component, topic, name, unit, device_class, state_class, precision, expire_after) AS (VALUES {", ".join("(" + ", ".join(_q(v) for v in r) + ")" for r in _DISCOVERED)})
SELECT device, cat.* FROM d, cat
UNION ALL SELECT device, 'sensor', 'cell_voltages/' || i, 'Cell Volt ' || CASE WHEN device = 'bms0' THEN lpad(CAST(i AS VARCHAR), 2, '0') ELSE CAST(i AS VARCHAR) END, 'V', 'voltage', NULL, 3, 20 FROM d, range(1, 13) r(i) WHERE i <= CASE WHEN device = 'bms0' THEN 12 ELSE 4 END
UNION ALL SELECT device, 'sensor', 'temperatures/' || i, 'Temperatures ' || i, '°C', 'temperature', NULL, 1, 20 FROM d, range(1, 4) r(i) WHERE i = 1 OR (i = 3 AND device <> 'bms1')""",
)
def entity_discovery(spark, sf_dir):
    """bms0 has twelve cells; the second probe of all packs and the third of bms1 never have a value."""
    cells = F.when(F.col("device") == "bms0", F.concat("cell_mv", "cell_mv", "cell_mv")).otherwise(F.col("cell_mv"))
    third = F.when(F.col("device") != "bms1", F.col("mos_temperature"))
    df = samples(spark, sf_dir).select("device", "voltage", "current", "mos_temperature", "switches", cells.alias("cell_mv"), F.array(F.col("mos_temperature"), F.lit(None).cast("double"), third).alias("temperatures"))
    return P.entity_discovery(df, 20)
