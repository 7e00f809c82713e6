"""Streaming queries, run to the end of the available files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwatt.operators import folds as O
from fleetwatt.operators import meters as M
from fleetwatt.operators.aggregate import METER_EXPIRY_S
from fleetwatt.operators.timeline import DEVICE_TIME, micros
from fleetwatt.plans.captured import packets, told
from fleetwatt.plans.energy import INC
from fleetwatt.plans.filters import LHQ_Q, LHQ_SPAN
from fleetwatt.plans.joined import ambient, pack_samples
from fleetwatt.plans.registry import ORACLES, query, r6
from fleetwatt.plans.telemetry import OPTIONS, TEL, sample_stream, samples
from fleetwatt.streaming import folds as S
from fleetwatt.streaming.run import meter_snapshots, run_to_table, split_late, stream_dir

#: what the watermark has passed when all files are read with a delay of one hour
WM = "wm AS (SELECT (max(t_us) // 1000 - 3600000) * 1000 AS w FROM tel)"


def _input(spark, sf_dir):
    return sample_stream(spark, sf_dir).withColumn("power", F.col("voltage") * F.col("current"))


@query(
    "stream_meters",
    f"""WITH {TEL}, {INC}, {WM}, r AS (SELECT event_id, device, t_us, sum(d_charge) OVER w AS total_charge, sum(d_net) OVER w AS total_energy, sum(d_dis) OVER w AS total_energy_discharge,
       sum(d_chg) OVER w AS total_energy_charge, sum(d_cyc) OVER w AS total_cycles, sum(d_abs) OVER w AS total_abs_diff_charge FROM inc WINDOW w AS (PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, device, round(total_charge, 6) + 0.0 AS total_charge, round(total_energy, 6) + 0.0 AS total_energy, round(total_energy_discharge, 6) + 0.0 AS total_energy_discharge, round(total_energy_charge, 6) + 0.0 AS total_energy_charge,
       round(total_cycles, 6) + 0.0 AS total_cycles, round(total_abs_diff_charge, 6) + 0.0 AS total_abs_diff_charge FROM r, wm WHERE t_us <= w""",
)
def stream_meters(spark, sf_dir):
    """Every reading the watermark has released equals the batch reading."""
    out = run_to_table(S.stream_meters(_input(spark, sf_dir), 3600.0, delay="1 hour"))
    return out.select("event_id", "device", *[r6(m).alias(m) for m in M.METERS])


@query(
    "stream_downsample",
    f"""WITH {TEL}, {WM}, b AS (SELECT device, (t_us // 600000000) * 600 AS bucket, count(*) AS n_samples, round(avg(voltage), 6) + 0.0 AS voltage, round(avg(current), 6) + 0.0 AS current, arg_max(soc, event_id) AS soc FROM tel GROUP BY ALL)
SELECT b.* FROM b, wm WHERE (bucket + 600) * 1000000 <= w""",
)
def stream_downsample(spark, sf_dir):
    df = _input(spark, sf_dir).select("event_id", "device", "ts", "voltage", "current", "power", "soc")
    out = run_to_table(S.stream_downsample(df, "10 minutes", "1 hour"))
    return out.select("device", "bucket", "n_samples", r6("voltage").alias("voltage"), r6("current").alias("current"), "soc")


@query(
    "stream_throttle",
    f"""WITH RECURSIVE {TEL}, {WM}, s AS (SELECT event_id, device, t_us, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) AS rn FROM tel, wm WHERE t_us <= w),
f AS (SELECT event_id, device, rn, t_us AS l, true AS kept FROM s WHERE rn = 1
  UNION ALL SELECT s.event_id, s.device, s.rn, CASE WHEN s.t_us - f.l >= 2700000000 THEN s.t_us ELSE f.l END, s.t_us - f.l >= 2700000000 FROM f JOIN s ON s.device = f.device AND s.rn = f.rn + 1)
SELECT event_id, device, kept FROM f""",
)
def stream_throttle(spark, sf_dir):
    """A batch fold, live."""
    args = {"t_us": micros("ts"), "seed_us": F.lit(None).cast("long")}
    out = run_to_table(S.stream_fold(_input(spark, sf_dir), O.Throttle(2_700_000_000), args, "1 hour"))
    return out.select("event_id", "device", "kept")


@query(
    "stream_runtime",
    f"""WITH RECURSIVE {TEL}, {WM}, g AS (SELECT event_id, device, t_us, current, charge, row_number() OVER (PARTITION BY device ORDER BY ts, event_id) AS ln FROM tel, wm WHERE t_us <= w),
f AS (SELECT event_id, device, ln, t_us, NULL::DOUBLE AS cad, CASE WHEN current > 0 THEN current END AS amps, charge FROM g WHERE ln = 1
  UNION ALL SELECT event_id, device, ln, t_us, CASE WHEN stale THEN NULL WHEN cad IS NULL THEN dt ELSE (1 - 2.0::DOUBLE / 7) * cad + 2.0::DOUBLE / 7 * dt END,
    CASE WHEN current > 0 THEN CASE WHEN stale OR amps IS NULL THEN current ELSE (1 - 2.0::DOUBLE / 7) * amps + 2.0::DOUBLE / 7 * current END END, charge
  FROM (SELECT g.event_id, g.device, g.ln, g.t_us, g.current, g.charge, f.cad, f.amps, (g.t_us - f.t_us) / 1e6 AS dt, f.cad IS NOT NULL AND (g.t_us - f.t_us) / 1e6 > greatest(10, 4 * f.cad) AS stale FROM f JOIN g ON g.device = f.device AND g.ln = f.ln + 1))
SELECT event_id, device, round(CASE WHEN amps > 0 THEN charge / amps * 3600 END, 4) + 0.0 AS runtime FROM f""",
)
def stream_runtime(spark, sf_dir):
    args = {"t_us": micros("ts"), "current": F.col("current"), "charge": F.col("charge"), "reported": F.lit(None).cast("double")}
    out = run_to_table(S.stream_fold(_input(spark, sf_dir), O.Runtime(), args, "1 hour"))
    return out.select("event_id", "device", (F.round(F.col("runtime") * 1e4, 0) / 1e4 + F.lit(0.0)).alias("runtime"))


def released(name: str) -> str:
    """The rows of a batch query that the watermark has passed: filters don't look ahead."""
    return f"WITH {TEL}, {WM} SELECT b.* FROM ({ORACLES[name]}) b JOIN tel t ON t.event_id = b.event_id JOIN wm ON t.t_us <= wm.w"


@query("stream_temp_filter", released("temp_filter"))
def stream_temp_filter(spark, sf_dir):
    """Arrays of sensors, live: the MOSFET sensor first, then the probes."""
    every = F.array(F.col("mos_temperature") + 5, F.col("mos_temperature"), F.when(F.col("k") % 9 != 0, F.col("k") / 2.0))
    fold = O.Quantizer(LHQ_Q, LHQ_SPAN, "t", sensors=True)
    out = run_to_table(S.stream_fold(_input(spark, sf_dir), fold, {"x": every}, "1 hour"))
    probe = lambda i: (F.rint(F.get("t", F.lit(i)) * 100) / 100 + 0.0).alias(f"temperature_{i - 1}")
    return out.select("event_id", "device", probe(1), probe(2), r6(F.get("t", F.lit(0))).alias("mos_temperature"))


@query("stream_ewma", released("ewma"))
def stream_ewma(spark, sf_dir):
    x = F.when(F.col("event_id") % 13 != 0, F.col("current"))
    out = run_to_table(S.stream_fold(_input(spark, sf_dir), O.Ewma(6), {"x": x.cast("double")}, "1 hour"))
    return out.select("event_id", "device", r6("ewma").alias("ewma"))


@query("stream_zscore", released("ewm_zscore"))
def stream_zscore(spark, sf_dir):
    out = run_to_table(S.stream_fold(_input(spark, sf_dir), O.EwmZScore(120, 0.1), {"x": F.col("power")}, "1 hour"))
    return out.select("event_id", "device", *[r6(c).alias(c) for c in ("ewm_mean", "ewm_stddev", "z_score")])


@query("stream_keepalive", released("keepalive_dedup"))
def stream_keepalive(spark, sf_dir):
    """Two topics a device; what is sent again after a while is what the batch query sends."""
    on = lambda s: F.when(F.col("switches")[s], "ON").otherwise("OFF")
    topics = F.create_map(F.lit("switch/charge"), on("charge"), F.lit("switch/discharge"), on("discharge"))
    long = _input(spark, sf_dir).select("event_id", "device", "ts", F.explode(topics).alias("topic", "value"))
    args = {"t_us": micros("ts"), "v": F.col("value")}
    out = run_to_table(S.stream_fold(long, O.KeepAlive(3_000_000_000), args, "1 hour", tl=DEVICE_TIME.with_keys("device", "topic")))
    values = samples(spark, sf_dir).select("event_id", F.explode(topics).alias("topic", "value"))
    return out.filter("emitted").join(values, ["event_id", "topic"]).select("event_id", "device", "topic", "value")


@query(
    "stream_late",
    f"""WITH {TEL} SELECT event_id, device, CASE WHEN event_id % 50 > 30 THEN 'late' ELSE 'fresh' END AS kind FROM tel""",
)
def stream_late(spark, sf_dir):
    """Both sides of the age rule, each in a table of its own; none is lost: a repeat is the same event, not another of its instant."""
    fresh, late = S.late_policy(_input(spark, sf_dir), 30.0)
    fresh = S.drop_repeats(fresh, "1 hour", ("device", "ts", "event_id"))
    out = [
        run_to_table(df.select("event_id", "device")).withColumn("kind", F.lit(kind)) for kind, df in (("fresh", fresh), ("late", late))
    ]
    return out[0].unionByName(out[1])


@query(
    "stream_sessions",
    f"""WITH {TEL}, {WM}, g AS (SELECT device, t_us, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY device ORDER BY t_us) < 3600000000 THEN 0 ELSE 1 END AS b FROM tel),
s AS (SELECT *, sum(b) OVER (PARTITION BY device ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT device, count(*) AS n_samples, min(t_us) AS first_us, max(t_us) AS last_us FROM s, wm GROUP BY device, n, w HAVING max(t_us) + 3600000000 <= w""",
)
def stream_sessions(spark, sf_dir):
    out = run_to_table(S.stream_outages(_input(spark, sf_dir), "1 hour", "1 hour"))
    return out.select("device", "n_samples", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


@query(
    "stream_user_sinks",
    f"""WITH {TEL} SELECT 'points' AS sink, count(*) AS n FROM tel UNION ALL SELECT 'cells', count(*) * 4 FROM tel""",
)
def stream_user_sinks(spark, sf_dir):
    """Three sinks on one stream; the one that fails does not stop the others."""
    from fleetwatt.sinks.points import fan_out
    from fleetwatt.sources.readers import cells_long

    folder = stream_dir(spark)

    def points(batch, batch_id):
        batch.select("event_id", "device", "ts", "voltage").write.mode("overwrite").parquet(f"{folder}/points/batch={batch_id}")

    def cells(batch, batch_id):
        cells_long(batch, ("device", "event_id")).write.mode("overwrite").parquet(f"{folder}/cells/batch={batch_id}")

    def broken(batch, batch_id):
        raise OSError("store is away")

    feed = fan_out({"broken": broken, "points": points, "cells": cells}, on_error=lambda name, error: None)
    q = (
        _input(spark, sf_dir).writeStream.foreachBatch(feed).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    count = lambda name: spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("sink"), "n")
    return count("points").unionByName(count("cells"))


@query(
    "stream_append",
    f"""WITH {TEL} SELECT device, count(*) AS n, round(sum(voltage), 3) + 0.0 AS voltage FROM tel GROUP BY device""",
)
def stream_append(spark, sf_dir):
    """Bounded appends of raw points."""
    from fleetwatt.streaming.run import batch_append

    folder = stream_dir(spark)
    batch_append(_input(spark, sf_dir).select("event_id", "device", "ts", "voltage"), f"{folder}/data", f"{folder}/checkpoint").awaitTermination()
    out = spark.read.parquet(f"{folder}/data")
    return out.groupBy("device").agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("voltage"), 3) + F.lit(0.0)).alias("voltage"))


@query(
    "stream_meter_snapshots",
    f"""WITH {TEL}, {INC}, {WM}, r AS (SELECT event_id, device, t_us, sum(d_net) OVER w AS e, sum(d_cyc) OVER w AS c FROM inc WINDOW w AS (PARTITION BY device ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT device, (t_us // 30000000) * 30 AS period, round_even(arg_max(e, event_id), 5) + 0.0 AS meter_total_energy, round_even(arg_max(c, event_id), 5) + 0.0 AS meter_total_cycles FROM r, wm WHERE t_us <= w GROUP BY ALL""",
)
def stream_meter_snapshots(spark, sf_dir):
    """What a restart would find: the stored readings, later batches over earlier ones."""
    folder = stream_dir(spark)
    meter_snapshots(S.stream_meters(_input(spark, sf_dir), 3600.0, delay="1 hour"), f"{folder}/data", f"{folder}/checkpoint").awaitTermination()
    stored = spark.read.parquet(f"{folder}/data")
    last = stored.groupBy("device", "period").agg(F.max_by(F.struct("meter_total_energy", "meter_total_cycles"), "batch").alias("m"))
    return last.select("device", "period", *[(F.col(f"m.{c}") + F.lit(0.0)).alias(c) for c in ("meter_total_energy", "meter_total_cycles")])


@query("stream_soc_controller", released("soc_controller"))
def stream_soc_controller(spark, sf_dir):
    """Commands live, by the algorithm text of each device; full charges are due every 120 hours."""
    text = [(d["alias"].strip(), f"{d['algorithm'].split(';')[0]} 10% 20% 120") for d in OPTIONS["devices"] if "algorithm" in d]
    devices = spark.createDataFrame(text, "device string, algorithm string")
    df = _input(spark, sf_dir).withColumn("soc", F.when(F.col("k") == 99, 100).otherwise(F.col("k"))).withColumn("switch_charge", F.col("switches")["charge"])
    out = run_to_table(S.stream_soc_controller(df, devices, "1 hour"))
    return out.select("event_id", "device", F.lit("charge").alias("switch"), "value", "reason")


@query("stream_pack_temp", released("pack_temp"))
def stream_pack_temp(spark, sf_dir):
    """The thermal model live: ambient readings come on the stream too."""
    df = _input(spark, sf_dir)
    packs = pack_samples(df).withColumn("mos_temperature", F.when(F.col("event_id") % 17 != 0, F.col("mos_temperature")))
    out = run_to_table(S.stream_pack_temperature(packs, ambient(df), [f"bms{i}" for i in range(4)], delay="1 hour"))
    return out.select("event_id", "device", r6("pack_temperature").alias("pack_temperature"))


@query("stream_reassemble", released("reassemble"))
def stream_reassemble(spark, sf_dir):
    """Packets as a stream of files; frames come out as they are completed."""
    folder = f"{stream_dir(spark)}/packets"
    packets(spark, sf_dir).write.parquet(folder)
    chunks = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    return told(run_to_table(S.stream_reassemble(chunks, "jbd", "1 hour")))


@query(
    "stream_late_rows",
    f"""WITH RECURSIVE {TEL}, c AS (SELECT device, max(CASE WHEN event_id % 37 <> 0 THEN t_us END) - 3600000000 AS passed, max(t_us) - 3600000000 AS w FROM tel GROUP BY device),
m AS (SELECT event_id, tel.device, t_us, w, event_id % 37 = 0 AND t_us <= passed AS late FROM tel JOIN c ON c.device = tel.device),
s AS (SELECT *, row_number() OVER (PARTITION BY device ORDER BY t_us, event_id) AS rn FROM m WHERE NOT late AND t_us <= w),
f AS (SELECT event_id, device, rn, t_us AS l, true AS kept FROM s WHERE rn = 1
  UNION ALL SELECT s.event_id, s.device, s.rn, CASE WHEN s.t_us - f.l >= 2700000000 THEN s.t_us ELSE f.l END, s.t_us - f.l >= 2700000000 FROM f JOIN s ON s.device = f.device AND s.rn = f.rn + 1)
SELECT event_id, device, false AS late, kept FROM f UNION ALL SELECT event_id, device, true, NULL FROM m WHERE late""",
)
def stream_late_rows(spark, sf_dir):
    """One row in 37 comes after all others, up to weeks behind: too late for the fold, and in a table of its own."""
    folder = stream_dir(spark)
    rows = samples(spark, sf_dir).select("event_id", "device", "ts")
    rows.filter("event_id % 37 <> 0").write.parquet(f"{folder}/feed/first")
    n = len(spark.read.parquet(f"{folder}/feed/first").inputFiles())
    rows.filter("event_id % 37 = 0").coalesce(n).write.parquet(f"{folder}/feed/second")
    feed = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", n).parquet(f"{folder}/feed")
    args = {"t_us": micros("ts"), "seed_us": F.lit(None).cast("long")}
    fresh, late = split_late(S.stream_fold(feed, O.Throttle(2_700_000_000), args, keep_late_s=3600.0), f"{folder}/data", f"{folder}/checkpoint")
    side = lambda df, is_late: df.select("event_id", "device", F.lit(is_late).alias("late"), "kept")
    return side(fresh, False).unionByName(side(late, True))


@query(
    "stream_entities",
    f"""WITH {TEL}, {WM}, s AS (SELECT device, event_type AS entity, t_us, w, CASE WHEN event_type = 'purchase' THEN 7200000000 ELSE 3600000000 END AS e FROM tel, wm WHERE t_us <= w),
n AS (SELECT *, lag(t_us) OVER o AS p, lead(t_us) OVER o AS q FROM s WINDOW o AS (PARTITION BY device, entity ORDER BY t_us))
SELECT device, entity, t_us AS at_us, true AS available FROM n WHERE p IS NULL OR t_us - p > e
UNION ALL SELECT device, entity, t_us + e, false FROM n WHERE q - t_us > e OR (q IS NULL AND w > t_us + e)""",
)
def stream_entities(spark, sf_dir):
    """Entities that fall silent and come back; those of meters stay shown for two hours at least."""
    df = _input(spark, sf_dir).select("event_id", "device", "ts", F.col("event_type").alias("entity"))
    expire = F.when(F.col("entity") == "purchase", F.lit(max(3600.0, METER_EXPIRY_S))).otherwise(F.lit(3600.0))
    out = run_to_table(S.stream_entities(df, expire, "1 hour"))
    return out.select("device", "entity", micros("ts").alias("at_us"), "available")
