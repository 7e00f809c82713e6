"""Roll-ups over the telemetry view."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwatt.operators import aggregate as A
from fleetwatt.operators import meters as M
from fleetwatt.operators.prefix import in_runs
from fleetwatt.plans.energy import GAP_S, INC, metered, powered
from fleetwatt.plans.registry import query, r6
from fleetwatt.plans.telemetry import TEL, events, samples


@query(
    "downsample_10m",
    f"""WITH {TEL}
SELECT device, (t_us // 600000000) * 600 AS bucket, count(*) AS n_samples, round(avg(voltage), 6) + 0.0 AS voltage, round(avg(current), 6) + 0.0 AS current,
       round(CASE WHEN arg_max(event_type, event_id) = 'purchase' THEN avg(coalesce(power_explicit, voltage * current)) ELSE avg(voltage) * avg(current) END, 6) + 0.0 AS power,
       arg_max(soc, event_id) AS soc, max(event_id) AS event_id, arg_max(problem_code, event_id) AS problem_code
FROM tel GROUP BY ALL""",
)
def downsample_10m(spark, sf_dir):
    df = samples(spark, sf_dir).select("event_id", "device", "ts", "voltage", "current", F.col("power_explicit").alias("power"), "soc", "problem_code")
    out = A.downsample(df, 600)
    return out.select("device", "bucket", "n_samples", r6("voltage").alias("voltage"), r6("current").alias("current"),
                      r6("power").alias("power"), "soc", "event_id", "problem_code")


#: 2024-01-01 to 2024-02-01 UTC
T0, T1 = 1704067200, 1706745600


@query(
    "bucket_mean",
    f"""WITH {TEL} SELECT device, (t_us // 3600000000) * 3600 AS bucket, round(avg(current), 6) + 0.0 AS mean_value FROM tel GROUP BY ALL""",
)
def bucket_mean(spark, sf_dir):
    df = samples(spark, sf_dir).withColumn("bucket", A.bucket_start(3600))
    return df.groupBy("device", "bucket").agg(r6(F.avg("current")).alias("mean_value"))


@query(
    "bucket_mean_fill",
    f"""WITH {TEL}, g AS (SELECT d AS device, b AS bucket FROM (VALUES ('bms0'), ('bms2')) v(d), generate_series({T0}::BIGINT, {T1 - 1800}::BIGINT, 1800) s(b)),
m AS (SELECT device, (t_us // 1800000000) * 1800 AS bucket, round(avg(soc), 6) + 0.0 AS mean_value FROM tel GROUP BY ALL)
SELECT device, bucket, mean_value FROM g LEFT JOIN m USING (device, bucket)""",
)
def bucket_mean_fill(spark, sf_dir):
    """Two entities, every interval of the month, NULL where nothing was reported."""
    out = A.bucket_mean(samples(spark, sf_dir), F.col("soc"), 1800, T0, T1, "device", ("bms0", "bms2"))
    return out.select("device", "bucket", r6("mean_value").alias("mean_value"))


@query(
    "bucket_mean_pooled",
    f"""WITH {TEL}, g AS (SELECT b AS bucket FROM generate_series({T0}::BIGINT, {T1 - 600}::BIGINT, 600) s(b)),
m AS (SELECT (t_us // 600000000) * 600 AS bucket, round(avg(mos_temperature), 6) + 0.0 AS mean_value FROM tel GROUP BY ALL)
SELECT bucket, mean_value FROM g LEFT JOIN m USING (bucket)""",
)
def bucket_mean_pooled(spark, sf_dir):
    """All entities in one series."""
    out = A.bucket_mean(samples(spark, sf_dir), F.col("mos_temperature"), 600, T0, T1)
    return out.select("bucket", r6("mean_value").alias("mean_value"))


@query(
    "daily_utility_meter",
    f"""WITH {TEL}, {INC}, r AS (SELECT device, ts, event_id, t_us, sum(d_dis) OVER w AS reading FROM inc WINDOW w AS (PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, CASE WHEN event_id % 400 < 200 THEN reading ELSE reading - 1 END AS shown FROM r),
u AS (SELECT device, (t_us // 86400000000) AS day, greatest(shown - lag(shown) OVER (PARTITION BY device ORDER BY ts, event_id), 0) AS use FROM z)
SELECT device, day, round(coalesce(sum(use), 0), 6) + 0.0 AS consumption FROM u GROUP BY device, day""",
)
def daily_utility_meter(spark, sf_dir):
    """Daily discharge energy from the running meter, through resets of the shown reading."""
    df = M.meter_increments(in_runs(metered(spark, sf_dir)), GAP_S)
    df = M.meter_readings(df, before=("total_energy_discharge", "event_id"))
    shown = lambda x: F.when(F.col(f"event_id{x}") % 400 < 200, F.col(f"total_energy_discharge{x}")).otherwise(F.col(f"total_energy_discharge{x}") - 1)
    out = M.utility_meter(df, shown(""), "day", previous=shown("_before"))
    return out.select("device", F.expr("unix_micros(cycle_start) div 86400000000").alias("day"), r6("consumption").alias("consumption"))


@query(
    "learned_cell_count",
    f"""WITH {TEL}, p AS (SELECT event_id, device, ts, list_transform(cell_mv, lambda v, i: CASE WHEN i > event_id // 97 % 5 OR v % 50 = 0 THEN 0 ELSE v END) AS c FROM tel),
n AS (SELECT *, coalesce(list_max(list_transform(c, lambda v, i: CASE WHEN v <> 0 THEN i END)), 0) AS pop FROM p),
h AS (SELECT *, max(pop) OVER (PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cell_count FROM n)
SELECT event_id, device, CAST(cell_count AS INTEGER) AS cell_count, array_to_string(c[1:cell_count], ',') AS cells FROM h""",
)
def learned_cell_count(spark, sf_dir):
    pos = F.floor(F.col("event_id") / 97) % 5
    cells = F.transform("cell_mv", lambda v, i: F.when((i + 1 > pos) | (v % 50 == 0), F.lit(0)).otherwise(v))
    df = A.learned_cell_count(samples(spark, sf_dir).select("event_id", "device", "ts", cells.alias("cell_mv")))
    return df.select("event_id", "device", F.col("cell_count").cast("int").alias("cell_count"),
                     F.array_join(F.col("cell_mv").cast("array<string>"), ",").alias("cells"))


@query(
    "sample_count",
    f"""WITH {TEL} SELECT event_id, device, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) - 1 AS num_samples FROM tel""",
)
def sample_count(spark, sf_dir):
    return A.sample_count(samples(spark, sf_dir).select("event_id", "device", "ts"))[["event_id", "device", "num_samples"]]


@query(
    "energy_reconcile",
    f"""WITH {TEL}, {INC}
SELECT device, (t_us // 86400000000) AS day, round(sum(d_net), 6) + 0.0 AS net_kwh, abs(sum(d_net) - (sum(d_dis) - sum(d_chg))) < 1e-6 AS balanced
FROM inc GROUP BY ALL""",
)
def energy_reconcile(spark, sf_dir):
    """The identity must hold per device and day too, since it holds for every interval."""
    inc = M.meter_increments(powered(spark, sf_dir), GAP_S).withColumn("day", F.expr("unix_micros(ts) div 86400000000"))
    out = M.reconcile_energy(M.meter_totals(inc, ("device", "day")))
    return out.select("device", "day", r6("total_energy").alias("net_kwh"), "balanced")


@query(
    "stale_values",
    """WITH e AS (SELECT 'user' || user_id AS device, event_type AS entity, value, epoch_us(ts) AS t FROM events),
m AS (SELECT max(t) AS now FROM e)
SELECT device, entity, arg_max(value, t) AS value, max(t) AS seen_us, min(now) - max(t) <= 172800000000 AS available FROM e, m GROUP BY device, entity""",
)
def stale_values(spark, sf_dir):
    """What every entity shows at the end of the log, two days before it goes unavailable."""
    df = events(spark, sf_dir).select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("device"), F.col("event_type").alias("entity"), "ts", "value")
    return A.latest_values(df, df.agg(F.max(F.unix_micros("ts"))).scalar(), 172_800.0)
