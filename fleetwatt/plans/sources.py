"""Source and schema queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwatt.functions.scalar import nan_to_null
from fleetwatt.operators.timeline import Timeline
from fleetwatt.plans.registry import query, r6
from fleetwatt.plans.telemetry import TEL, events, samples
from fleetwatt.sources import readers as R


@query(
    "read_samples",
    f"""WITH {TEL}
SELECT device, count(*) AS samples, count(CASE WHEN event_id % 7 <> 0 THEN voltage END) AS known_voltages,
       round(avg(CASE WHEN event_id % 7 <> 0 THEN voltage END), 6) + 0.0 AS avg_voltage,
       round(max(CASE WHEN event_id % 7 <> 0 THEN voltage END), 6) + 0.0 AS max_voltage
FROM tel GROUP BY device""",
)
def read_samples(spark, sf_dir):
    """A device that reports NaN voltages now and then: NaN must be NULL before anything is aggregated."""
    df = samples(spark, sf_dir)
    df = df.withColumn("voltage", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("voltage")))
    return nan_to_null(df).groupBy("device").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count("voltage").alias("known_voltages"),
        r6(F.avg("voltage")).alias("avg_voltage"),
        r6(F.max("voltage")).alias("max_voltage"),
    )


@query(
    "cells_long",
    f"""WITH {TEL}
SELECT device, event_id, i AS cell_index, cell_mv[i + 1] AS mv FROM tel, range(4) r(i)""",
)
def cells_long(spark, sf_dir):
    return R.cells_long(samples(spark, sf_dir), ("device", "event_id"))


@query(
    "cells_wide",
    f"""WITH {TEL}
SELECT device, event_id, array_to_string(cell_mv, ',') AS cells FROM tel""",
)
def cells_wide(spark, sf_dir):
    wide = R.cells_wide(R.cells_long(samples(spark, sf_dir), ("device", "event_id")), ("device", "event_id"))
    return wide.select("device", "event_id", F.array_join(F.col("cell_mv").cast("array<string>"), ",").alias("cells"))


@query(
    "normalize_vendor",
    f"""WITH {TEL}
SELECT event_id, device, soc, round(voltage, 6) + 0.0 AS voltage, round(current, 6) + 0.0 AS current,
       round(power_explicit, 6) + 0.0 AS power, charge, capacity, sw_charge AS charge_on, sw_discharge AS discharge_on,
       ['UNKNOWN', 'BULK', 'ABSORPTION', 'FLOAT'][event_id % 4 + 1] AS battery_mode,
       array_to_string(cell_mv[1:3], ',') AS cells, round(mos_temperature, 6) + 0.0 AS temperature
FROM tel""",
)
def normalize_vendor(spark, sf_dir):
    """Two plug-in releases with opposite sign and different switch keys, united in the canonical schema."""
    base = samples(spark, sf_dir)

    def release(df, charge_key, discharge_key):
        return df.select(
            "event_id", "device", "ts", "voltage",
            (-F.col("current")).alias("current"), (-F.col("power_explicit")).alias("power"),
            F.col("soc").alias("battery_level"), F.col("charge").alias("cycle_charge"),
            F.col("capacity").alias("design_capacity"), F.col("mos_temperature").alias("temperature"),
            F.col("switches")["charge"].alias(charge_key), F.col("switches")["discharge"].alias(discharge_key),
            (F.col("event_id") % 4).alias("battery_mode"),
            F.transform("cell_mv", lambda v: v / 1000.0).alias("cell_voltages"), F.lit(3).alias("cell_count"),
        )

    old = release(base.filter("event_id % 2 = 0"), "chrg_mosfet", "dischrg_mosfet")
    new = release(base.filter("event_id % 2 = 1"), "sw_chrg_mosfet", "sw_dischrg_mosfet")
    out = []
    for part in (old, new):
        out.append(R.normalize_vendor(part, {"event_id": ("event_id",), **R.plugin_mapping(part)}))
    return R.union_vendors(out).select(
        "event_id", "device", "soc", r6("voltage").alias("voltage"), r6("current").alias("current"), r6("power").alias("power"),
        "charge", "capacity", F.col("switches")["charge"].alias("charge_on"), F.col("switches")["discharge"].alias("discharge_on"),
        "battery_mode", F.array_join(F.col("cell_mv").cast("array<string>"), ",").alias("cells"),
        r6(F.get("temperatures", F.lit(0))).alias("temperature"),
    )


DEVICE_DOC_SQL = """docs AS (
  SELECT c_custkey AS n, c_name AS alias,
         CASE c_custkey % 5 WHEN 0 THEN '#' || 'C0:' || c_custkey WHEN 1 THEN '  ' || 'C0:' || c_custkey || ' ' WHEN 2 THEN '' ELSE 'C0:' || c_custkey END AS address,
         CASE c_custkey % 3 WHEN 0 THEN 'jbd' WHEN 1 THEN ' snoop: jbd,jk ' ELSE 'jk' END AS type,
         CASE c_custkey % 4 WHEN 0 THEN 1.025 WHEN 1 THEN -1.0 END AS calibration,
         CASE c_custkey % 2 WHEN 0 THEN 'soc 90% 70%; soc 80%' END AS algorithm
  FROM customer)"""


def device_docs(spark, sf_dir):
    """One options entry per customer, as the JSON a user writes."""
    n = F.col("c_custkey")
    phone = F.concat(F.lit("C0:"), n.cast("string"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.to_json(
            F.struct(
                F.col("c_name").alias("alias"),
                F.when(n % 5 == 0, F.concat(F.lit("#"), phone)).when(n % 5 == 1, F.concat(F.lit("  "), phone, F.lit(" ")))
                .when(n % 5 == 2, "").otherwise(phone).alias("address"),
                F.when(n % 3 == 0, "jbd").when(n % 3 == 1, " snoop: jbd,jk ").otherwise("jk").alias("type"),
                F.when(n % 4 == 0, 1.025).when(n % 4 == 1, -1.0).alias("current_calibration"),
                F.when(n % 2 == 0, "soc 90% 70%; soc 80%").alias("algorithm"),
            )
        ).alias("doc")
    )


@query(
    "device_options",
    f"""WITH {DEVICE_DOC_SQL}
SELECT alias AS device, trim(address) AS address, trim(split_part(trim(type), ':', 1)) AS type,
       nullif(trim(split_part(trim(type), ':', 2)), '') AS spec, coalesce(calibration, 1.0)::DOUBLE AS current_calibration,
       CASE WHEN algorithm IS NULL THEN NULL ELSE 'soc 90% 70%|soc 80%' END AS algorithms
FROM docs WHERE trim(address) <> '' AND trim(address) NOT LIKE '#%'""",
)
def device_options(spark, sf_dir):
    return R.parse_device_docs(device_docs(spark, sf_dir)).select(
        "device", "address", "type", "spec", "current_calibration", F.array_join("algorithms", "|").alias("algorithms")
    )


@query(
    "ambient_payloads",
    """WITH p AS (
  SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 11 AS m, value FROM events)
SELECT event_id, CASE WHEN m IN (0, 1, 2, 3, 4, 5) THEN CASE WHEN m = 1 AND k * 10 >= 200 THEN NULL WHEN m = 1 THEN k * 10.0 ELSE k / 2.0 END
                      WHEN m = 6 THEN CAST(k AS DOUBLE) END::DOUBLE AS celsius
FROM p""",
)
def ambient_payloads(spark, sf_dir):
    """Numbers, JSON under each key, a present but unusable first key, and junk."""
    k, m = F.get_json_object("props", "$.k").cast("int"), F.col("event_id") % 11
    half = (k / 2.0).cast("string")
    q = F.lit('"')
    payload = (
        F.when(m == 0, F.concat(F.lit(" "), half))
        .when(m == 1, (k * 10).cast("string"))
        .when(m == 2, F.concat(F.lit('{"value": '), half, F.lit("}")))
        .when(m == 3, F.concat(F.lit('{"state": "'), half, F.lit('"}')))
        .when(m == 4, F.concat(F.lit('{"t": 99, "temperature": '), half, F.lit("}")))
        .when(m == 5, F.concat(F.lit('{"temp": '), half, F.lit(', "unit": "C"}')))
        .when(m == 6, F.concat(F.lit('{"t": '), k.cast("string"), F.lit("}")))
        .when(m == 7, F.concat(F.lit('{"value": "unavailable", "temp": '), half, F.lit("}")))
        .when(m == 8, "unavailable")
        .when(m == 9, "{ not json }")
    )
    return events(spark, sf_dir).select("event_id", R.parse_ambient(payload).alias("celsius"))


@query(
    "group_members",
    """WITH g AS (SELECT s_suppkey AS n, s_name AS grp, 'bms' || (s_suppkey % 7) || ',,bms' || (s_suppkey % 5) || ', bms' || (s_suppkey % 7) || ' ,x' AS address FROM supplier),
m AS (SELECT n, grp, trim(m) AS member, i FROM (SELECT n, grp, unnest(string_split(address, ',')) AS m, generate_subscripts(string_split(address, ','), 1) AS i FROM g) WHERE trim(m) <> ''),
d AS (SELECT grp, member, min(i) AS i FROM m GROUP BY grp, member)
SELECT grp AS "group", member, CAST(row_number() OVER (PARTITION BY grp ORDER BY i) - 1 AS INTEGER) AS ord FROM d""",
)
def group_members(spark, sf_dir):
    """Group entries, one per supplier, with empty and repeated members."""
    n = F.col("s_suppkey")
    text = F.concat(
        F.lit("bms"), (n % 7).cast("string"), F.lit(",,bms"), (n % 5).cast("string"), F.lit(", bms"), (n % 7).cast("string"), F.lit(" ,x")
    )
    docs = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.to_json(F.struct(F.col("s_name").alias("alias"), text.alias("address"), F.lit("group_parallel").alias("type"))).alias("doc")
    )
    return R.read_group_members(R.parse_device_docs(docs)).select("group", "member", "ord")


#: what each kind of event measures
_SIGNALS = {"view": "voltage", "click": "current", "signup": "soc", "purchase": "power", "error": "temperature"}
_LAST = ",\n".join(f"  last_value(CASE WHEN signal = '{s}' THEN value END IGNORE NULLS) OVER w AS {s}, last_value(CASE WHEN signal = '{s}' THEN t_us END IGNORE NULLS) OVER w AS t_{s}" for s in _SIGNALS.values())


@query(
    "assemble_signals",
    f"""WITH {TEL}, s AS (
  SELECT event_id, device, ts, t_us, CASE event_type {" ".join(f"WHEN '{e}' THEN '{s}'" for e, s in _SIGNALS.items())} END AS signal, value FROM tel),
k AS (SELECT event_id, device, t_us,
{_LAST}
  FROM s WINDOW w AS (PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, device, greatest({", ".join(f"t_{s}" for s in _SIGNALS.values())}) AS sample_us, {", ".join(_SIGNALS.values())},
       {", ".join(f"t_us - t_{s} > 1800000000 AS stale_{s}" for s in _SIGNALS.values())}
FROM k""",
)
def assemble_signals(spark, sf_dir):
    """Each kind of event is a signal of its own."""
    named = F.create_map(*[F.lit(x) for pair in _SIGNALS.items() for x in pair])[F.col("event_type")]
    log = samples(spark, sf_dir).select("event_id", "device", "ts", "value", named.alias("signal"))
    wide = R.assemble_signals(log, tuple(_SIGNALS.values()), 1800.0, Timeline())
    return wide.withColumn("sample_us", F.unix_micros("sample_ts")).drop("ts", "sample_ts")
