"""Ordered operators over the telemetry view: meters, jumps, latches, outages, change-only rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwatt.operators import meters as M
from fleetwatt.operators import windows as W
from fleetwatt.operators.prefix import in_runs
from fleetwatt.plans.energy import GAP_S, INC, metered, powered
from fleetwatt.plans.registry import query, r6
from fleetwatt.plans.telemetry import TEL, samples

WIN = "(PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(
    "running_integral",
    f"""WITH {TEL}, y AS (SELECT event_id, device, ts, t_us, power_explicit AS y FROM tel),
k AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN t_us END IGNORE NULLS) OVER b AS pt, last_value(y IGNORE NULLS) OVER b AS py FROM y
  WINDOW b AS (PARTITION BY device ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, coalesce(CASE WHEN (t_us - pt) / 3.6e9 <= 2 THEN (t_us - pt) / 3.6e9 * (py + y) / 2 END, 0) AS inc FROM k)
SELECT event_id, device, round(sum(inc) OVER {WIN}, 6) + 0.0 AS reading FROM i""",
)
def running_integral(spark, sf_dir):
    """Trapezoid over a signal that most rows lack."""
    df = samples(spark, sf_dir).select("event_id", "device", "ts", "power_explicit")
    return M.integrate(df, F.col("power_explicit"), 7200.0, "reading").select("event_id", "device", r6("reading").alias("reading"))


@query(
    "running_abs_diff",
    f"""WITH {TEL}, y AS (SELECT event_id, device, ts, t_us, CASE WHEN event_id % 6 <> 0 THEN soc END AS y FROM tel),
k AS (SELECT *, lag(t_us) OVER w AS pt, lag(y) OVER w AS py FROM y WINDOW w AS (PARTITION BY device ORDER BY ts, event_id)),
i AS (SELECT *, coalesce(CASE WHEN (t_us - pt) <= 3600000000 AND abs(y - py) <= 25 THEN abs(y - py) END, 0) AS inc FROM k)
SELECT event_id, device, round(sum(inc) OVER {WIN}, 6) + 0.0 AS reading FROM i""",
)
def running_abs_diff(spark, sf_dir):
    """A missing value breaks the chain on both sides."""
    df = samples(spark, sf_dir).select("event_id", "device", "ts", F.when(F.col("event_id") % 6 != 0, F.col("soc")).alias("y"))
    return M.abs_diff_sum(df, F.col("y"), 3600.0, 25.0, "reading").select("event_id", "device", r6("reading").alias("reading"))


@query(
    "meter_readings",
    f"""WITH {TEL}, {INC}
SELECT event_id, device, round(sum(d_charge) OVER w, 6) + 0.0 AS total_charge, round(sum(d_net) OVER w, 6) + 0.0 AS total_energy, round(sum(d_dis) OVER w, 6) + 0.0 AS total_energy_discharge,
       round(sum(d_chg) OVER w, 6) + 0.0 AS total_energy_charge, round(sum(d_cyc) OVER w, 6) + 0.0 AS total_cycles, round(sum(d_abs) OVER w, 6) + 0.0 AS total_abs_diff_charge
FROM inc WINDOW w AS {WIN}""",
)
def meter_readings(spark, sf_dir):
    df = M.meter_readings(M.meter_increments(in_runs(metered(spark, sf_dir)), GAP_S))
    return df.select("event_id", "device", *[r6(m).alias(m) for m in M.METERS])


@query(
    "restored_meters",
    f"""WITH {TEL}, {INC}, t AS (SELECT device, sum(d_charge) AS total_charge, sum(d_net) AS total_energy, sum(d_dis) AS total_energy_discharge, sum(d_chg) AS total_energy_charge, sum(d_cyc) AS total_cycles, sum(d_abs) AS total_abs_diff_charge FROM inc GROUP BY device),
u AS (UNPIVOT t ON total_charge, total_energy, total_energy_discharge, total_energy_charge, total_cycles, total_abs_diff_charge INTO NAME meter VALUE v),
s AS (SELECT device, 'total_energy' AS meter, max(value) AS reading FROM tel WHERE event_type = 'purchase' AND device <> 'bms3' GROUP BY device)
SELECT device, meter, round(coalesce(reading, 0) + v, 6) + 0.0 AS reading FROM u LEFT JOIN s USING (device, meter)""",
)
def restored_meters(spark, sf_dir):
    """Totals on top of a stored snapshot that knows one meter of three devices."""
    totals = M.meters_long(M.meter_totals(M.meter_increments(powered(spark, sf_dir), GAP_S)).drop("samples"))
    snapshot = (
        samples(spark, sf_dir).filter("event_type = 'purchase' AND device <> 'bms3'").groupBy("device")
        .agg(F.max("value").alias("reading")).withColumn("meter", F.lit("total_energy"))
    )
    return M.restore_meters(totals, snapshot).select("device", "meter", r6("reading").alias("reading"))


@query(
    "power_jump",
    f"""WITH {TEL}, p AS (SELECT event_id, device, ts, t_us, voltage * current AS p, coalesce(lag(voltage * current) OVER (PARTITION BY device ORDER BY ts, event_id), 0) AS q FROM tel),
j AS (SELECT *, abs((p - q) / (abs(q) + 120)) > 0.15 AND abs(p) > abs(q) AS jump FROM p),
h AS (SELECT *, last_value(CASE WHEN jump THEN t_us END IGNORE NULLS) OVER {WIN} AS tj FROM j)
SELECT event_id, device, jump, coalesce(t_us - tj < 600000000, false) AS jump_hold FROM h""",
)
def power_jump(spark, sf_dir):
    """Held for ten minutes here, since the test devices report every few minutes."""
    return W.power_jump(powered(spark, sf_dir), hold_s=600.0).select("event_id", "device", "jump", "jump_hold")


@query(
    "changed_only",
    f"""WITH {TEL}, f AS (SELECT event_id, device, ts, CAST(soc / 25 AS INTEGER) AS level, sw_charge, CASE WHEN event_type = 'purchase' THEN NULL ELSE event_type END AS mode FROM tel),
l AS (SELECT *, lag(level) OVER w AS pl, lag(sw_charge) OVER w AS pc, lag(mode) OVER w AS pm FROM f WINDOW w AS (PARTITION BY device ORDER BY ts, event_id)),
c AS (SELECT event_id, device, CASE WHEN event_id % 200 = 0 OR level IS DISTINCT FROM pl THEN level END AS level, CASE WHEN event_id % 200 = 0 OR sw_charge IS DISTINCT FROM pc THEN sw_charge END AS sw_charge,
  CASE WHEN event_id % 200 = 0 OR mode IS DISTINCT FROM pm THEN mode END AS mode FROM l)
SELECT * FROM c WHERE level IS NOT NULL OR sw_charge IS NOT NULL OR mode IS NOT NULL""",
)
def changed_only(spark, sf_dir):
    df = samples(spark, sf_dir).select(
        "event_id", "device", "ts", F.bround(F.col("soc") / 25).cast("int").alias("level"),
        F.col("switches")["charge"].alias("sw_charge"), F.when(F.col("event_type") != "purchase", F.col("event_type")).alias("mode"),
    )
    return W.changed_only(df, ("level", "sw_charge", "mode"), F.col("event_id") % 200 == 0).drop("ts")


@query(
    "soc_latch",
    f"""WITH {TEL} SELECT event_id, device, coalesce(last_value(CASE WHEN soc >= 90 THEN false WHEN soc <= least(70, 89.8) THEN true END IGNORE NULLS) OVER {WIN}, true) AS charging FROM tel""",
)
def soc_latch(spark, sf_dir):
    return W.soc_latch(samples(spark, sf_dir), 90.0, 70.0).select("event_id", "device", "charging")


@query(
    "weakest_cell",
    f"""WITH {TEL}, c AS (SELECT event_id, device, ts, list_min(cell_mv) AS lo, list_max(cell_mv) AS hi, list_position(cell_mv, list_min(cell_mv)) - 1 AS li, list_position(cell_mv, list_max(cell_mv)) - 1 AS hi_i FROM tel),
r AS (SELECT *, min({{'l': lo, 't': ts, 'c': li}}) OVER w AS em, min({{'l': -hi, 't': ts, 'c': hi_i}}) OVER w AS fu FROM c WINDOW w AS {WIN}),
e AS (SELECT *, CASE WHEN lo < 2700 THEN {{'w': CASE WHEN li = fu.c THEN li END}} WHEN hi > 3500 THEN {{'w': CASE WHEN hi_i = em.c THEN hi_i END}} END AS ev FROM r)
SELECT event_id, device, CAST((last_value(ev IGNORE NULLS) OVER {WIN}).w AS INTEGER) AS weakest_cell FROM e""",
)
def weakest_cell(spark, sf_dir):
    return W.weakest_cell(samples(spark, sf_dir)).select("event_id", "device", "weakest_cell")


@query(
    "outages",
    f"""WITH {TEL}, g AS (SELECT device, t_us, lag(t_us) OVER (PARTITION BY device ORDER BY ts, event_id) AS p FROM tel)
SELECT device, p AS lost_us, t_us AS back_us, round((t_us - p) / 1e6, 6) + 0.0 AS gap_s FROM g WHERE (t_us - p) / 1e6 > 3600""",
)
def outages(spark, sf_dir):
    out = W.outages(samples(spark, sf_dir).select("device", "ts", "event_id"), 3600.0)
    return out.select("device", F.unix_micros("lost_at").alias("lost_us"), F.unix_micros("back_at").alias("back_us"), r6("gap_s").alias("gap_s"))


@query(
    "segments",
    f"""WITH {TEL}, g AS (SELECT event_id, device, ts, (t_us - lag(t_us) OVER (PARTITION BY device ORDER BY ts, event_id)) / 1e6 AS gap FROM tel)
SELECT event_id, device, CAST(sum(CASE WHEN gap > 1800 THEN 1 ELSE 0 END) OVER {WIN} AS BIGINT) AS segment FROM g""",
)
def segments(spark, sf_dir):
    return W.segments(samples(spark, sf_dir).select("device", "ts", "event_id"), 1800.0).select("event_id", "device", "segment")


@query(
    "current_direction",
    f"""WITH {TEL}, f AS (SELECT event_id, device, ts, current, CASE WHEN event_id % 4 = 0 THEN NULL ELSE sw_charge END AS chg, sw_discharge AS dis FROM tel),
k AS (SELECT *, last_value(CASE WHEN chg <> dis THEN chg END IGNORE NULLS) OVER {WIN} AS d FROM f)
SELECT event_id, device, round(CASE WHEN d THEN -abs(current) WHEN NOT d THEN abs(current) ELSE current END, 6) + 0.0 AS current,
       round(CASE WHEN dis AND NOT coalesce(chg, false) THEN abs(current) WHEN coalesce(chg, false) AND NOT dis THEN -abs(current) ELSE -current END, 6) + 0.0 AS memoryless FROM k""",
)
def current_direction(spark, sf_dir):
    df = samples(spark, sf_dir).select(
        "event_id", "device", "ts", "current",
        F.when(F.col("event_id") % 4 != 0, F.col("switches")["charge"]).alias("chg"), F.col("switches")["discharge"].alias("dis"),
    )
    plain = W.direction_without_memory(F.col("current"), F.coalesce("chg", F.lit(False)), F.col("dis"))
    df = W.resolve_direction(df.withColumn("memoryless", r6(plain)), "current", "chg", "dis")
    return df.select("event_id", "device", r6("current").alias("current"), "memoryless")
