"""Row-level measures over the telemetry view."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwatt.functions import scalar as S
from fleetwatt.plans.registry import query, r6
from fleetwatt.plans.telemetry import TEL, samples


@query(
    "power",
    f"""WITH {TEL} SELECT event_id, device, round(coalesce(power_explicit, voltage * current), 6) + 0.0 AS power FROM tel""",
)
def power(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", "device", r6(S.power("power_explicit")).alias("power"))


@query(
    "derived_soc_soh",
    f"""WITH {TEL}, v AS (
  SELECT event_id, device, CASE WHEN event_id % 4 = 0 THEN NULL ELSE soc END AS soc, event_id % 2 = 0 AS soc_is_int,
         CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS charge, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 280.0::DOUBLE END AS capacity,
         CASE WHEN event_id % 6 = 1 THEN 250.0::DOUBLE END AS aged, CASE WHEN event_id % 6 = 2 THEN 97.0::DOUBLE END AS soh FROM tel),
d AS (SELECT *, CASE WHEN capacity > 0 AND (soc IS NULL OR (soc_is_int AND charge > 0)) THEN round_even(charge / capacity * 100, 2) ELSE soc END AS soc2,
         CASE WHEN capacity IS NULL AND soc > 0.2 AND charge IS NOT NULL THEN round_even(charge / soc * 100, 0) ELSE capacity END AS cap2 FROM v)
SELECT event_id, device, round(soc2, 6) + 0.0 AS soc, round(cap2, 6) + 0.0 AS capacity,
       round(CASE WHEN cap2 > 0 AND aged IS NULL AND soh IS NOT NULL THEN cap2 * soh / 100 ELSE aged END, 6) + 0.0 AS aged_capacity,
       round(CASE WHEN cap2 > 0 AND soh IS NULL AND aged IS NOT NULL THEN aged / cap2 * 100 ELSE soh END, 6) + 0.0 AS soh
FROM d""",
)
def derived_soc_soh(spark, sf_dir):
    e = F.col("event_id")
    df = samples(spark, sf_dir).select(
        "event_id", "device",
        F.when(e % 4 != 0, F.col("soc")).alias("soc"), (e % 2 == 0).alias("soc_is_int"),
        F.when(e % 5 != 0, F.col("value")).alias("charge"), F.when(e % 3 != 0, F.lit(280.0)).alias("capacity"),
        F.when(e % 6 == 1, F.lit(250.0)).alias("aged_capacity"), F.when(e % 6 == 2, F.lit(97.0)).alias("soh"),
    )
    df = S.derive_soh_aged(S.derive_soc_capacity(df))
    return df.select("event_id", "device", *[r6(c).alias(c) for c in ("soc", "capacity", "aged_capacity", "soh")])


@query(
    "derived_problem",
    f"""WITH {TEL} SELECT event_id, device, coalesce(CASE WHEN event_id % 9 = 0 THEN true WHEN event_id % 9 = 1 THEN false END, problem_code <> 0) AS problem FROM tel""",
)
def derived_problem(spark, sf_dir):
    explicit = F.when(F.col("event_id") % 9 == 0, True).when(F.col("event_id") % 9 == 1, False)
    return samples(spark, sf_dir).select("event_id", "device", S.derive_problem(explicit).alias("problem"))


@query(
    "expired_filter",
    f"""WITH {TEL} SELECT event_id, device FROM tel WHERE epoch_us(ts) >= epoch_us(ingest_ts) - greatest(0, 20) * 1000000""",
)
def expired_filter(spark, sf_dir):
    return S.drop_expired(samples(spark, sf_dir)).select("event_id", "device")


@query(
    "sentinels",
    f"""WITH {TEL}, r AS (SELECT event_id, CASE event_id % 2 WHEN 0 THEN 'ant' ELSE 'jk' END AS vendor,
  CASE WHEN event_id % 6 = 0 THEN 65496 WHEN event_id % 6 = 1 THEN -2000 ELSE k * 10 END AS raw,
  list_transform(cell_mv, lambda x: CASE WHEN x % 3 = 0 THEN 61001 WHEN x % 3 = 1 THEN 0 ELSE x END) AS cells FROM tel)
SELECT event_id, CASE WHEN vendor = 'ant' AND raw = 65496 OR vendor = 'jk' AND raw = -2000 THEN NULL ELSE raw END AS raw,
       array_to_string(list_filter(cells, lambda x: x <> 61001 AND x <> 0), ',') AS cells FROM r""",
)
def sentinels(spark, sf_dir):
    e = F.col("event_id")
    vendor = F.when(e % 2 == 0, "ant").otherwise("jk")
    raw = F.when(e % 6 == 0, F.lit(65496)).when(e % 6 == 1, F.lit(-2000)).otherwise(F.col("k") * 10)
    cells = F.transform("cell_mv", lambda x: F.when(x % 3 == 0, F.lit(0xEE49)).when(x % 3 == 1, F.lit(0)).otherwise(x))
    return samples(spark, sf_dir).select(
        "event_id",
        S.sentinel_to_null(raw, vendor, "temperature").alias("raw"),
        F.array_join(S.drop_sentinels(cells, S.SENTINELS["modbus", "cell"]).cast("array<string>"), ",").alias("cells"),
    )


@query(
    "range_quarantine",
    f"""WITH {TEL}, r AS (SELECT event_id, device, CASE WHEN event_id % 10 = 0 THEN k + 50.0 ELSE soc END AS soc,
  CASE WHEN event_id % 10 = 1 THEN [0, 0] WHEN event_id % 10 = 2 THEN [3300, 48000 + k] WHEN event_id % 10 = 3 THEN []::INTEGER[] WHEN event_id % 10 = 4 THEN [0, 3300] ELSE cell_mv END AS cells,
  CASE WHEN event_id % 10 = 5 THEN k * 4.0 ELSE mos_temperature END AS temp FROM tel),
q AS (SELECT *, CASE WHEN soc < 0 OR soc > 100 THEN 'soc_range' WHEN len(cells) < 1 THEN 'cell_count'
  WHEN len(list_filter(cells, lambda v: v <> 0)) = 0 THEN 'all_cells_zero' WHEN list_max(cells) >= 48000 THEN 'cell_spike'
  WHEN temp <= -100 OR temp >= 200 THEN 'temperature_range' END AS reason,
  CASE WHEN list_min(cells) < 2000 THEN 'cell_low' WHEN list_max(cells) > 4500 THEN 'cell_high' END AS cell_reason FROM r)
SELECT event_id, device, reason AS reject_reason, cell_reason FROM q WHERE reason IS NOT NULL
UNION ALL SELECT event_id, device, NULL, cell_reason FROM q WHERE reason IS NULL AND cell_reason IS NOT NULL""",
)
def range_quarantine(spark, sf_dir):
    e, k = F.col("event_id"), F.col("k")
    df = samples(spark, sf_dir).select(
        "event_id", "device",
        F.when(e % 10 == 0, k + 50.0).otherwise(F.col("soc")).alias("soc"),
        F.when(e % 10 == 1, F.array(F.lit(0), F.lit(0)))
        .when(e % 10 == 2, F.array(F.lit(3300), F.lit(48000) + k))
        .when(e % 10 == 3, F.array().cast("array<int>"))
        .when(e % 10 == 4, F.array(F.lit(0), F.lit(3300)))
        .otherwise(F.col("cell_mv")).alias("cell_mv"),
        F.when(e % 10 == 5, k * 4.0).otherwise(F.col("mos_temperature")).alias("mos_temperature"),
    ).withColumn("cell_reason", S.cell_range_reason())
    good, bad = S.quarantine(df, S.reject_reason())
    odd = good.filter("cell_reason IS NOT NULL").withColumn("reject_reason", F.lit(None).cast("string"))
    return bad.unionByName(odd).select("event_id", "device", "reject_reason", "cell_reason")


@query(
    "round_significant",
    f"""WITH {TEL}, x AS (SELECT event_id, unnest([4, 5]) AS n, value * pow(10, event_id % 7) - 20 AS x FROM tel),
d AS (SELECT *, n - 1 - floor(log10(abs(x))) AS d FROM x)
SELECT event_id, n, round(CASE WHEN x = 0 THEN x WHEN d >= 0 THEN round_even(x * pow(10, d), 0) / pow(10, d) ELSE round_even(x / pow(10, -d), 0) * pow(10, -d) END, 6) + 0.0 AS y FROM d""",
)
def round_significant(spark, sf_dir):
    x = F.col("value") * F.pow(F.lit(10.0), F.col("event_id") % 7) - 20
    df = samples(spark, sf_dir).select("event_id", x.alias("x"))
    parts = [df.select("event_id", F.lit(n).alias("n"), r6(S.round_sig("x", n)).alias("y")) for n in (4, 5)]
    return parts[0].unionByName(parts[1])


@query(
    "flatten",
    f"""WITH {TEL}
SELECT event_id, device, round(voltage, 6) + 0.0 AS voltage, sw_charge AS switches_charge, sw_discharge AS switches_discharge, CAST(NULL AS BOOLEAN) AS switches_balance,
       round(mos_temperature, 6) + 0.0 AS temperatures_0, k / 2.0::DOUBLE AS temperatures_1, CAST(NULL AS DOUBLE) AS temperatures_2,
       cell_mv[1] AS voltage_cell000, cell_mv[2] AS voltage_cell001, cell_mv[3] AS voltage_cell002, cell_mv[4] AS voltage_cell003 FROM tel""",
)
def flatten(spark, sf_dir):
    df = samples(spark, sf_dir).withColumn("temperatures", F.array(r6("mos_temperature"), F.col("k") / 2.0))
    df = df.withColumn("voltage", r6("voltage"))
    return df.select(*S.flatten_columns(("event_id", "device", "voltage"), ("charge", "discharge", "balance"), 3, 4))


@query(
    "hash_ids",
    """WITH h AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_name END AS s FROM customer),
b AS (SELECT c_custkey, s, regexp_replace(sha1(s), '(..)(..)', '\\2', 'g') AS x FROM h)
SELECT c_custkey, CASE WHEN s <> '' THEN replace(translate(to_base64(unhex(x)), '+/', '-_'), '=', '') END AS id FROM b""",
)
def hash_ids(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.col("c_name"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", S.hash_id(name).alias("id"))


FLAG_SQL = " ".join(f"(w & {m}) > 0 AS {n}," for n, m in S.STATE_MASKS.items())


@query(
    "bit_flags",
    f"""WITH {TEL}, b AS (SELECT event_id, k, (event_id * 2654435761) % 65536 AS w FROM tel)
SELECT event_id, {FLAG_SQL} (w & 61443) >= 61440 AS status_normal, (k & 1) > 0 AS di1, (k & 32) > 0 AS do2, (k & 128) > 0 AS do4,
       CAST(w & 4095 AS INTEGER) AS mv, (w & 32768) > 0 AS balancing,
       CASE event_id % 4 WHEN 0 THEN 'stationary' WHEN 1 THEN 'charging' ELSE 'discharging' END AS mode FROM b""",
)
def bit_flags(spark, sf_dir):
    w = ((F.col("event_id") * F.lit(2654435761)) % 65536).cast("int")
    io = S.bits("k", S.IO_NAMES)
    cell = S.packed_cell(w)
    return samples(spark, sf_dir).select(
        "event_id",
        *[c.alias(n) for n, c in S.working_state(w).items()],
        io["DI1"].alias("di1"), io["DO2"].alias("do2"), io["DO4"].alias("do4"),
        cell["mv"].alias("mv"), cell["balancing"].alias("balancing"),
        S.mode_label(F.col("event_id") % 4).alias("mode"),
    )


#: fixed values: status bits of one family as (byte offset, mask, kind, error mask); kind 0 is benign
STATUS_BITS = (
    (0, 0x08, 2, 0x0004), (0, 0x10, 2, 0x0200), (0, 0x20, 2, 0x0801), (0, 0x40, 2, 0x0801), (0, 0x80, 2, 0x0800),
    (1, 0x01, 2, 0x0800), (1, 0x02, 2, 0x0800), (1, 0x04, 2, 0x0200), (1, 0x08, 2, 0x0008), (1, 0x10, 1, 0x0001),
    (1, 0x20, 1, 0x0001), (1, 0x40, 1, 0x0001), (1, 0x80, 2, 0x0801),
    (2, 0x01, 2, 0x0008), (2, 0x02, 2, 0x0010), (2, 0x10, 2, 0x0001), (2, 0x20, 2, 0x0001), (2, 0x40, 1, 0x0800),
    (3, 0x01, 0, 0x0000), (3, 0x02, 0, 0x0000), (3, 0x04, 2, 0x0400), (3, 0x08, 2, 0x0080), (3, 0x10, 2, 0x0002),
    (3, 0x40, 2, 0x0020), (3, 0x80, 2, 0x0040),
    (4, 0x01, 2, 0x0010), (4, 0x02, 2, 0x0008), (4, 0x10, 2, 0x0001),
    (5, 0x01, 0, 0x0001), (5, 0x02, 0, 0x0001), (5, 0x04, 0, 0x0001), (5, 0x08, 0, 0x0001), (5, 0x10, 0, 0x0000),
    (5, 0x20, 2, 0x0008), (5, 0x40, 2, 0x0010), (5, 0x80, 2, 0x0010),
    (7, 0x01, 1, 0x0001), (7, 0x02, 1, 0x0001), (7, 0x04, 0, 0x0001), (7, 0x08, 2, 0x0001), (7, 0x10, 1, 0x0001),
    (7, 0x20, 2, 0x0800), (7, 0x40, 1, 0x0001), (7, 0x80, 1, 0x0001),
    (8, 0x01, 1, 0x0008), (8, 0x02, 1, 0x0010), (8, 0x04, 1, 0x0008), (8, 0x08, 1, 0x0001), (8, 0x10, 1, 0x1000),
    (8, 0x20, 1, 0x0008), (8, 0x40, 1, 0x0010),
    (9, 0x01, 1, 0x0002), (9, 0x02, 1, 0x0004), (9, 0x04, 1, 0x0002), (9, 0x08, 1, 0x0004), (9, 0x10, 1, 0x0100),
    (9, 0x20, 1, 0x0080), (9, 0x40, 1, 0x0020), (9, 0x80, 1, 0x0040),
)
STATUS_BITS_SQL = ", ".join(f"({o}, {m}, {e})" for o, m, kind, e in STATUS_BITS if kind >= 1)


@query(
    "alarm_codes",
    f"""WITH {TEL}, b AS (SELECT event_id, list_transform(range(10), lambda i: (event_id * (2 * i + 3) + 17 * i) % 256) AS s FROM tel),
t(o, m, e) AS (VALUES {STATUS_BITS_SQL}),
c AS (SELECT event_id, bit_or(CASE WHEN (coalesce(s[o + 1], 0) & m) > 0 THEN e ELSE 0 END) AS table_code FROM b, t GROUP BY event_id)
SELECT event_id, CAST(s[1] | ((s[2] & 127) << 8) | (s[3] << 16) AS BIGINT) AS three_code,
       CAST((s[1] & 127) | ((s[2] & 127) << 8) | ((s[3] & 239) << 16) | (s[4] << 24) AS BIGINT) AS states_code, CAST(table_code AS INTEGER) AS table_code
FROM b JOIN c USING (event_id)""",
)
def alarm_codes(spark, sf_dir):
    status = F.array(*[((F.col("event_id") * (2 * i + 3) + 17 * i) % 256).cast("int") for i in range(10)])
    df = samples(spark, sf_dir).select("event_id", status.alias("s"))
    b = [F.get("s", F.lit(i)) for i in range(4)]
    return df.select(
        "event_id",
        S.alarm_code_three(b[0], b[1], b[2]).cast("long").alias("three_code"),
        S.alarm_code_states(b[0], b[1], b[2], b[3]).cast("long").alias("states_code"),
        S.alarm_code_table(F.col("s"), STATUS_BITS).alias("table_code"),
    )


@query(
    "topic_names",
    """SELECT p_partkey, regexp_replace(p_name || '-' || p_brand || '/' || p_type || '.1', '[^a-zA-Z0-9_./]', '_', 'g') AS topic,
       replace(regexp_replace(p_name || '-' || p_brand || '/' || p_type || '.1', '[^a-zA-Z0-9_./]', '_', 'g'), '/', '_') AS node FROM part""",
)
def topic_names(spark, sf_dir):
    name = F.concat("p_name", F.lit("-"), "p_brand", F.lit("/"), "p_type", F.lit(".1"))
    topic = S.topic_prefix(name)
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", topic.alias("topic"), S.node_id(topic).alias("node"))


@query(
    "parse_algorithm",
    f"""WITH {TEL}, a AS (SELECT event_id, k, event_id % 5 AS m FROM tel)
SELECT event_id, 'soc' AS name, CAST(k AS DOUBLE) AS charge_stop, least(CASE m WHEN 0 THEN 70.0 WHEN 2 THEN k / 2.0 WHEN 3 THEN 70.0 ELSE k END, k)::DOUBLE AS charge_start,
       CASE m WHEN 3 THEN 10.0 WHEN 4 THEN 15.0 END::DOUBLE AS discharge_stop, CASE m WHEN 3 THEN 20.0 END::DOUBLE AS discharge_start,
       CASE WHEN m = 3 THEN 360000.0 WHEN m = 4 AND event_id % 2 = 0 THEN 86400.0 WHEN m = 4 THEN 0.0 ELSE 1209600.0 END::DOUBLE AS calibration_s FROM a""",
)
def parse_algorithm(spark, sf_dir):
    """Five forms: one to five arguments in a row, and arguments by name."""
    k, m, lit = F.col("k").cast("string"), F.col("event_id") % 5, F.lit
    hours = F.when(F.col("event_id") % 2 == 0, "24").otherwise("null")
    text = (
        F.when(m == 0, F.concat(lit(" soc "), k, lit("% 70%")))
        .when(m == 1, F.concat(lit("soc "), k, lit("%")))
        .when(m == 2, F.concat(lit("soc "), k, lit(" "), (F.col("k") / 2.0).cast("string")))
        .when(m == 3, F.concat(lit("soc "), k, lit("% 70% 10% 20% 100")))
        .otherwise(F.concat(lit('{"name": "soc", "charge_stop": "'), k, lit('%", "discharge_stop": "15", "calibration_interval_h": '), hours, lit("}")))
    )
    return samples(spark, sf_dir).select("event_id", S.parse_algorithm(text).alias("a")).select("event_id", "a.*")


@query(
    "pack_voltage",
    f"""WITH {TEL} SELECT event_id, round(CASE WHEN event_id % 2 = 0 THEN voltage ELSE list_sum(cell_mv) / 1000.0 END, 6) + 0.0 AS voltage FROM tel""",
)
def pack_voltage(spark, sf_dir):
    reported = F.when(F.col("event_id") % 2 == 0, F.col("voltage"))
    return samples(spark, sf_dir).select("event_id", r6(S.pack_voltage(reported)).alias("voltage"))


@query(
    "capacity_rules",
    f"""WITH {TEL}, c AS (SELECT event_id, charge, soc, value AS fullc, CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE 100.0 END::DOUBLE AS design FROM tel)
SELECT event_id, round(CASE WHEN fullc > 0 THEN charge / fullc * 100 END, 6) + 0.0 AS soc, round(CASE WHEN design > 0 THEN least(100.0, fullc / design * 100) END, 6) + 0.0 AS soh,
       round(CASE WHEN charge > 0 AND fullc > 0 THEN round_even(charge / fullc * 100, 2) ELSE soc END, 6) + 0.0 AS soc_precise, round(design * soc / 100, 6) + 0.0 AS charge_ah FROM c""",
)
def capacity_rules(spark, sf_dir):
    q, full = F.col("charge"), F.col("value")
    design = F.when(F.col("event_id") % 5 == 0, F.lit(0.0)).otherwise(F.lit(100.0))
    return samples(spark, sf_dir).select(
        "event_id",
        r6(S.soc_from_full(q, full)).alias("soc"),
        r6(S.soh_from_design(full, design)).alias("soh"),
        r6(S.soc_from_aged(q, full, F.col("soc"))).alias("soc_precise"),
        r6(S.charge_from_soc(design, F.col("soc"))).alias("charge_ah"),
    )


@query(
    "net_current",
    f"""WITH {TEL} SELECT event_id, round((CASE WHEN k * 6.0 > 500 THEN 0 ELSE k * 6.0 END - CASE WHEN value > 500 THEN 0 ELSE value END)::DOUBLE, 6) + 0.0 AS current FROM tel""",
)
def net_current(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", r6(S.net_current(F.col("value"), F.col("k") * 6.0)).alias("current"))


@query(
    "temperature_roles",
    f"""WITH {TEL}, t AS (SELECT event_id, list_transform(range(event_id % 12), lambda i: (k + i * 3)::DOUBLE) AS temps FROM tel),
g AS (SELECT event_id, temps, list_transform(temps, lambda x, i: {{'tag': CASE WHEN i % 4 = 1 THEN 64 WHEN i % 4 = 2 THEN 32 ELSE 0 END, 'value': x}}) AS tagged FROM t)
SELECT event_id, array_to_string(temps[1:4] || temps[6:], ',') AS by_position, temps[5] AS mos_by_position,
       array_to_string(list_transform(list_filter(tagged, lambda x: x.tag = 0), lambda x: x.value) || list_transform(list_filter(tagged, lambda x: x.tag = 32)[-1:], lambda x: x.value), ',') AS by_tag,
       list_transform(list_filter(tagged, lambda x: x.tag = 64), lambda x: x.value)[-1] AS mos_by_tag
FROM g""",
)
def temperature_roles(spark, sf_dir):
    n = (F.col("event_id") % 12).cast("int")
    temps = F.transform(F.slice(F.sequence(F.lit(0), F.lit(11)), F.lit(1), n), lambda i: (F.col("k") + i * 3).cast("double"))
    df = samples(spark, sf_dir).select("event_id", temps.alias("t"))
    tagged = F.transform(
        "t",
        lambda x, i: F.struct(
            F.when((i + 1) % 4 == 1, F.lit(S.TAG_MOS)).when((i + 1) % 4 == 2, F.lit(S.TAG_AMBIENT)).otherwise(F.lit(0)).alias("tag"),
            x.alias("value"),
        ),
    )
    df = df.select("event_id", S.roles_by_position("t").alias("p"), S.roles_by_tag(tagged).alias("g"))
    return df.select(
        "event_id",
        F.array_join(F.col("p.temperatures").cast("array<string>"), ",").alias("by_position"),
        F.col("p.mos_temperature").alias("mos_by_position"),
        F.array_join(F.col("g.temperatures").cast("array<string>"), ",").alias("by_tag"),
        F.col("g.mos_temperature").alias("mos_by_tag"),
    )


CELL_STATS_SQL = """round(list_min(c) / 1000.0, 6)::DOUBLE AS min, list_position(c, list_min(c))::BIGINT AS min_index, round(list_max(c) / 1000.0, 6)::DOUBLE AS max, list_position(c, list_max(c))::BIGINT AS max_index,
       round((list_max(c) - list_min(c)) / 1000.0, 6)::DOUBLE AS delta, round_even(list_sum(c)::DOUBLE / list_count(c), 0) / 1000.0 AS average, round(list_median(c) / 1000.0, 6)::DOUBLE AS median"""


@query(
    "cell_stats",
    f"""WITH {TEL}, s AS (SELECT event_id, device, list_transform(cell_mv, lambda x: CASE WHEN x % 17 = 0 THEN NULL ELSE x END) AS c FROM tel)
SELECT event_id, device, {CELL_STATS_SQL} FROM s WHERE list_count(c) > 1""",
)
def cell_stats(spark, sf_dir):
    """Unreadable cells are ignored, their positions still count."""
    cells = F.transform("cell_mv", lambda x: F.when(x % 17 != 0, x))
    df = samples(spark, sf_dir).select("event_id", "device", S.cell_stats(cells).alias("s")).filter("s IS NOT NULL")
    return df.select("event_id", "device", "s.*")
