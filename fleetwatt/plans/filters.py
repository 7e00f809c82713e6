"""Order-dependent filters, throttles and the charge controller over the telemetry view."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwatt.operators import folds as O
from fleetwatt.operators import joins as J
from fleetwatt.operators import windows as W
from fleetwatt.operators.prefix import in_runs
from fleetwatt.plans.energy import powered
from fleetwatt.plans.joined import ambient, pack_samples
from fleetwatt.plans.registry import query, r6
from fleetwatt.plans.telemetry import TEL, samples

RN = "row_number() OVER (PARTITION BY device ORDER BY ts, event_id) AS rn"


@query(
    "ewma",
    f"""WITH RECURSIVE {TEL}, s AS (SELECT event_id, device, CASE WHEN event_id % 13 <> 0 THEN current END AS x, {RN} FROM tel),
f AS (SELECT event_id, device, rn, x AS y FROM s WHERE rn = 1
  UNION ALL SELECT s.event_id, s.device, s.rn, CASE WHEN s.x IS NULL THEN f.y WHEN f.y IS NULL THEN s.x ELSE (1 - 2.0::DOUBLE / 7) * f.y + 2.0::DOUBLE / 7 * s.x END FROM f JOIN s ON s.device = f.device AND s.rn = f.rn + 1)
SELECT event_id, device, round(y, 6) + 0.0 AS ewma FROM f""",
)
def ewma(spark, sf_dir):
    """Smoothed current; a missing reading leaves the filter as it is."""
    df = samples(spark, sf_dir).select("event_id", "device", "ts", F.when(F.col("event_id") % 13 != 0, F.col("current")).alias("current"))
    return O.ewma(df, F.col("current"), 6).select("event_id", "device", r6("ewma").alias("ewma"))


@query(
    "ewm_zscore",
    f"""WITH RECURSIVE {TEL}, s AS (SELECT event_id, device, voltage * current AS x, CASE WHEN voltage * current < 0 THEN -1 ELSE 1 END * (abs(voltage * current) + 0.1) AS r, {RN} FROM tel),
c AS (SELECT *, pow(least(abs((r - lag(r) OVER w) / lag(r) OVER w), 1.4), 2) AS c FROM s WINDOW w AS (PARTITION BY device ORDER BY rn)),
f AS (SELECT event_id, device, rn, x AS m, NULL::DOUBLE AS sd, x FROM c WHERE rn = 1
  UNION ALL SELECT c.event_id, c.device, c.rn, (1 - 2.0::DOUBLE / 121) * f.m + 2.0::DOUBLE / 121 * c.x, CASE WHEN f.sd IS NULL THEN c.c ELSE (1 - 2.0::DOUBLE / 121) * f.sd + 2.0::DOUBLE / 121 * c.c END, c.x FROM f JOIN c ON c.device = f.device AND c.rn = f.rn + 1)
SELECT event_id, device, round(m, 6) + 0.0 AS ewm_mean, round(abs(m * sd), 6) + 0.0 AS ewm_stddev, round((x - m) / (abs(m * sd) + 0.1), 6) + 0.0 AS z_score FROM f""",
)
def ewm_zscore(spark, sf_dir):
    df = powered(spark, sf_dir).select("event_id", "device", "ts", "power")
    out = O.ewm_zscore(df, F.col("power"), 120, 0.1)
    return out.select("event_id", "device", *[r6(c).alias(c) for c in ("ewm_mean", "ewm_stddev", "z_score")])


LHQ_Q, LHQ_SPAN = 0.5, 10
LHQ_SQL = f"""WITH RECURSIVE {TEL}, u AS (SELECT event_id, device, ts, unnest(['0', '1', 'mos']) AS sensor, unnest([mos_temperature, CASE WHEN k % 9 <> 0 THEN k / 2.0::DOUBLE END, mos_temperature + 5]) AS x FROM tel),
s AS (SELECT *, row_number() OVER (PARTITION BY device, sensor ORDER BY ts, event_id) AS rn FROM u),
f AS (SELECT event_id, device, sensor, rn, x AS e, round_even((x + 2 * x) / 3 * 2 / {LHQ_Q}, 0) * 0.5 * {LHQ_Q}::DOUBLE AS q, x FROM s WHERE rn = 1
  UNION ALL SELECT event_id, device, sensor, rn, e, CASE WHEN x IS NULL THEN q ELSE round_even((coalesce(q, x) + 2 * e) / 3 * 2 / {LHQ_Q}, 0) * 0.5 * {LHQ_Q}::DOUBLE END, x FROM (
    SELECT s.event_id, s.device, s.sensor, s.rn, f.q, s.x, CASE WHEN s.x IS NULL THEN f.e WHEN f.e IS NULL THEN s.x ELSE (1 - 2.0::DOUBLE / {LHQ_SPAN + 1}) * f.e + 2.0::DOUBLE / {LHQ_SPAN + 1} * s.x END AS e FROM f JOIN s ON s.device = f.device AND s.sensor = f.sensor AND s.rn = f.rn + 1))
SELECT event_id, device, round(max(CASE WHEN sensor = '0' THEN q END), 2) + 0.0 AS temperature_0, round(max(CASE WHEN sensor = '1' THEN q END), 2) + 0.0 AS temperature_1, round(max(CASE WHEN sensor = 'mos' THEN q END), 6) + 0.0 AS mos_temperature FROM f GROUP BY event_id, device"""


@query("temp_filter", LHQ_SQL)
def temp_filter(spark, sf_dir):
    """Two probes and the MOSFET sensor, each with a filter of its own; one probe drops out now and then."""
    df = samples(spark, sf_dir).select(
        "event_id", "device", "ts", (F.col("mos_temperature") + 5).alias("mos_temperature"),
        F.array(F.col("mos_temperature"), F.when(F.col("k") % 9 != 0, F.col("k") / 2.0)).alias("temperatures"),
    )
    out = O.temp_filter(df, LHQ_Q, LHQ_SPAN)
    return out.select("event_id", "device", (F.get("temperatures", F.lit(0)) + 0.0).alias("temperature_0"),
                      (F.get("temperatures", F.lit(1)) + 0.0).alias("temperature_1"), r6("mos_temperature").alias("mos_temperature"))


@query(
    "runtime",
    f"""WITH RECURSIVE {TEL}, s AS (SELECT event_id, device, t_us, current, CASE WHEN event_id % 11 <> 0 THEN charge END AS charge, CASE WHEN event_id % 29 = 0 THEN 1234.0::DOUBLE END AS rep, {RN} FROM tel),
n AS (SELECT *, rep IS NULL AS live FROM s), g AS (SELECT *, row_number() OVER (PARTITION BY device, live ORDER BY rn) AS ln FROM n),
f AS (SELECT event_id, device, ln, t_us, NULL::DOUBLE AS cad, CASE WHEN charge IS NOT NULL AND current > 0 THEN current END AS amps, charge FROM g WHERE live AND ln = 1
  UNION ALL SELECT event_id, device, ln, t_us, CASE WHEN stale THEN NULL WHEN cad IS NULL THEN dt ELSE (1 - 2.0::DOUBLE / 7) * cad + 2.0::DOUBLE / 7 * dt END,
    CASE WHEN charge IS NULL THEN CASE WHEN stale THEN NULL ELSE amps END WHEN current > 0 THEN CASE WHEN stale OR amps IS NULL THEN current ELSE (1 - 2.0::DOUBLE / 7) * amps + 2.0::DOUBLE / 7 * current END END, charge
  FROM (SELECT g.event_id, g.device, g.ln, g.t_us, g.current, g.charge, f.cad, f.amps, (g.t_us - f.t_us) / 1e6 AS dt, f.cad IS NOT NULL AND (g.t_us - f.t_us) / 1e6 > greatest(10, 4 * f.cad) AS stale
        FROM f JOIN g ON g.live AND g.device = f.device AND g.ln = f.ln + 1))
SELECT event_id, device, round(CASE WHEN amps > 0 THEN charge / amps * 3600 END, 4) + 0.0 AS runtime FROM f
UNION ALL SELECT event_id, device, rep FROM s WHERE rep IS NOT NULL""",
)
def runtime(spark, sf_dir):
    """Seconds to empty, with unknown charges and with values the device reports itself."""
    df = samples(spark, sf_dir).select(
        "event_id", "device", "ts", "current", F.when(F.col("event_id") % 11 != 0, F.col("charge")).alias("charge"),
        F.when(F.col("event_id") % 29 == 0, F.lit(1234.0)).alias("reported"),
    )
    out = O.runtime(df, reported="reported")
    return out.select("event_id", "device", (F.round(F.col("runtime") * 1e4, 0) / 1e4 + F.lit(0.0)).alias("runtime"))


@query(
    "pack_temp",
    f"""WITH RECURSIVE {TEL}, p AS (SELECT event_id, device, ts, t_us, CASE WHEN event_id % 17 <> 0 THEN mos_temperature END AS mos FROM tel WHERE event_type NOT IN ('view', 'signup')),
r AS (SELECT ts, k::DOUBLE AS v FROM tel WHERE event_type = 'view'), o AS (SELECT ts, k / 2.0::DOUBLE AS v FROM tel WHERE event_type = 'signup'),
a AS (SELECT p.*, CASE WHEN epoch_us(p.ts) - epoch_us(r.ts) <= 600000000 THEN r.v END AS room, CASE WHEN epoch_us(p.ts) - epoch_us(o.ts) <= 600000000 THEN o.v END AS outdoor FROM p ASOF LEFT JOIN r ON p.ts >= r.ts ASOF LEFT JOIN o ON p.ts >= o.ts),
d AS (SELECT *, 0.0017::DOUBLE + CASE WHEN room IS NULL THEN 0 ELSE 0.0006::DOUBLE END + CASE WHEN outdoor IS NULL THEN 0 ELSE 0.0009::DOUBLE END AS tot, 0.0017::DOUBLE * mos + coalesce(0.0006::DOUBLE * room, 0) + coalesce(0.0009::DOUBLE * outdoor, 0) AS pull FROM a WHERE mos IS NOT NULL),
s AS (SELECT *, {RN} FROM d),
f AS (SELECT event_id, device, ts, rn, t_us, (pull / tot)::DOUBLE AS y FROM s WHERE rn = 1
  UNION ALL SELECT s.event_id, s.device, s.ts, s.rn, s.t_us, CASE WHEN s.t_us - f.t_us > 3600000000 THEN s.pull / s.tot ELSE f.y + (s.pull - s.tot * f.y) * (s.t_us - f.t_us) / 6e7 END FROM f JOIN s ON s.device = f.device AND s.rn = f.rn + 1)
SELECT p.event_id, p.device, round(f.y, 6) + 0.0 AS pack_temperature FROM p ASOF LEFT JOIN f ON p.device = f.device AND p.ts >= f.ts""",
)
def pack_temp(spark, sf_dir):
    """Ambient as-of join, then the thermal model; rows without a MOSFET reading repeat the estimate."""
    df = samples(spark, sf_dir)
    packs = pack_samples(df).withColumn("mos_temperature", F.when(F.col("event_id") % 17 != 0, F.col("mos_temperature")))
    out = O.pack_temperature(J.asof_ambient(packs, ambient(df)).select("event_id", "device", "ts", "mos_temperature", "room", "outdoor"))
    return out.select("event_id", "device", r6("pack_temperature").alias("pack_temperature"))


THROTTLE_SQL = """f AS (SELECT event_id, device, rn, t_us, t_us AS l, true AS kept FROM s WHERE rn = 1
  UNION ALL SELECT s.event_id, s.device, s.rn, s.t_us, CASE WHEN s.t_us - f.l >= {us} THEN s.t_us ELSE f.l END, s.t_us - f.l >= {us} FROM f JOIN s ON s.device = f.device AND s.rn = f.rn + 1)"""


@query(
    "throttle",
    f"""WITH RECURSIVE {TEL}, s AS (SELECT event_id, device, t_us, {RN} FROM tel), {THROTTLE_SQL.format(us=2_700_000_000)}
SELECT event_id, device FROM f WHERE kept""",
)
def throttle(spark, sf_dir):
    """At most one row per device in 45 minutes, counted from the last kept one."""
    df = samples(spark, sf_dir).select("event_id", "device", "ts")
    return O.throttle(df, 2700.0).filter("kept").select("event_id", "device")


@query(
    "keepalive_dedup",
    f"""WITH RECURSIVE {TEL}, v AS (SELECT event_id, device, ts, t_us, unnest(['switch/charge', 'switch/discharge']) AS topic, unnest([CASE WHEN sw_charge THEN 'ON' ELSE 'OFF' END, CASE WHEN sw_discharge THEN 'ON' ELSE 'OFF' END]) AS value FROM tel),
s AS (SELECT *, row_number() OVER (PARTITION BY device, topic ORDER BY ts, event_id) AS rn FROM v),
f AS (SELECT event_id, device, topic, value, rn, t_us, t_us AS l, true AS emitted FROM s WHERE rn = 1
  UNION ALL SELECT s.event_id, s.device, s.topic, s.value, s.rn, s.t_us, CASE WHEN s.value <> f.value OR s.t_us - f.l >= 3000000000 THEN s.t_us ELSE f.l END, s.value <> f.value OR s.t_us - f.l >= 3000000000 FROM f JOIN s ON s.device = f.device AND s.topic = f.topic AND s.rn = f.rn + 1)
SELECT event_id, device, topic, value FROM f WHERE emitted""",
)
def keepalive_dedup(spark, sf_dir):
    on = lambda s: F.when(F.col("switches")[s], "ON").otherwise("OFF")
    long = samples(spark, sf_dir).select(
        "event_id", "device", "ts",
        F.explode(F.create_map(F.lit("switch/charge"), on("charge"), F.lit("switch/discharge"), on("discharge"))).alias("topic", "value"),
    )
    return O.keepalive_dedup(long, 3000.0).select("event_id", "device", "topic", "value")


@query(
    "publish_decision",
    f"""WITH RECURSIVE {TEL}, s AS (SELECT event_id, device, ts, t_us, voltage * current AS p, coalesce(lag(voltage * current) OVER (PARTITION BY device ORDER BY ts, event_id), 0) AS q, {RN} FROM tel),
h AS (SELECT *, last_value(CASE WHEN abs((p - q) / (abs(q) + 120)) > 0.15 AND abs(p) > abs(q) THEN t_us END IGNORE NULLS) OVER (PARTITION BY device ORDER BY rn ROWS UNBOUNDED PRECEDING) AS tj FROM s),
f AS (SELECT event_id, device, rn, t_us AS a, t_us AS b, true AS due, p, t_us, tj, period, disc FROM (SELECT *, false AS period, false AS disc FROM h WHERE rn = 1)
  UNION ALL SELECT h.event_id, h.device, h.rn, CASE WHEN h.t_us - f.a >= 1800000000 THEN h.t_us ELSE f.a END, CASE WHEN h.t_us - f.b >= 300000000 THEN h.t_us ELSE f.b END, f.period OR f.disc, h.p, h.t_us, h.tj,
    h.t_us - f.a >= 1800000000, h.t_us - f.b >= 300000000 FROM f JOIN h ON h.device = f.device AND h.rn = f.rn + 1)
SELECT event_id, device, due OR coalesce(t_us - tj < 4000000, false) OR abs(p) > 900 AS publish FROM f""",
)
def publish_decision(spark, sf_dir):
    df = powered(spark, sf_dir).select("event_id", "device", "ts", "power")
    return O.publish_decision(W.power_jump(in_runs(df)), 1800.0, over_power=900.0).select("event_id", "device", "publish")


@query(
    "soc_controller",
    f"""WITH RECURSIVE {TEL}, s AS (SELECT event_id, device, ts, t_us, CASE WHEN k = 99 THEN 100 ELSE k END AS soc, sw_charge AS sw, {RN} FROM tel),
f AS (SELECT event_id, device, rn, t_us AS l, CASE WHEN soc >= 90 THEN false ELSE true END AS st, CASE WHEN soc >= 90 AND sw THEN false END AS cmd, CASE WHEN soc >= 90 AND sw THEN 'stop' END AS why FROM s WHERE rn = 1
  UNION ALL SELECT event_id, device, rn, CASE WHEN need AND soc = 100 THEN t_us ELSE l END,
    CASE WHEN need AND soc = 100 THEN false WHEN need AND NOT sw THEN true WHEN need THEN st WHEN st AND soc >= 90 THEN false WHEN NOT st AND soc <= 70 THEN true ELSE st END,
    CASE WHEN need AND soc = 100 THEN false WHEN need AND NOT sw THEN true WHEN need THEN NULL WHEN st AND soc >= 90 AND sw THEN false WHEN NOT st AND soc <= 70 AND NOT sw THEN true END,
    CASE WHEN need AND soc = 100 THEN 'calibrated' WHEN need AND NOT sw THEN 'calibrate' WHEN need THEN NULL WHEN st AND soc >= 90 AND sw THEN 'stop' WHEN NOT st AND soc <= 70 AND NOT sw THEN 'start' END
  FROM (SELECT s.*, f.l, f.st, s.t_us - f.l > 432000000000 AS need FROM f JOIN s ON s.device = f.device AND s.rn = f.rn + 1))
SELECT event_id, device, 'charge' AS switch, cmd AS value, why AS reason FROM f WHERE cmd IS NOT NULL""",
)
def soc_controller(spark, sf_dir):
    """Calibration every five days here, since the test log is one month long."""
    df = samples(spark, sf_dir).select(
        "event_id", "device", "ts", F.when(F.col("k") == 99, 100).otherwise(F.col("k")).alias("soc"), F.col("switches")["charge"].alias("switch_charge")
    )
    return O.soc_controller(df, 90.0, 70.0, 5 * 86_400.0).drop("ts")

