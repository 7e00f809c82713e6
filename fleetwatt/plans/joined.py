"""Join and group queries over the telemetry view."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetwatt.functions.scalar import invert
from fleetwatt.operators import groups as G
from fleetwatt.operators import joins as J
from fleetwatt.operators import meters as M
from fleetwatt.plans.energy import GAP_S, powered
from fleetwatt.plans.registry import query, r6
from fleetwatt.plans.telemetry import TEL, events, samples
from fleetwatt.sources import readers as R


def device_table(spark, sf_dir):
    """Configuration entries of the devices that report, as the monitor's options document has them."""
    n = F.regexp_extract("device", r"(\d+)$", 1).cast("int")
    docs = samples(spark, sf_dir).select("device").distinct().select(
        F.to_json(
            F.struct(
                F.concat(F.lit(" "), F.col("device")).alias("alias"),
                F.format_string("C0:00:%02d ", n).alias("address"),
                F.lit("jbd").alias("type"),
                F.when(n % 4 == 1, 1.025).when(n % 4 == 2, -1.0).alias("current_calibration"),
                F.lit("soc 90% 70%").alias("algorithm"),
            )
        ).alias("doc")
    )
    return R.parse_device_docs(docs)


def member_table(spark, sf_dir):
    """Pairs of devices in parallel: g0 = bms0,bms1 and so on."""
    n = F.regexp_extract("device", r"(\d+)$", 1).cast("int")
    docs = (
        samples(spark, sf_dir).select("device").distinct().groupBy(F.floor(n / 2).alias("g"))
        .agg(F.array_join(F.array_sort(F.collect_list("device")), ",").alias("address"))
        .select(F.to_json(F.struct(F.concat(F.lit("g"), F.col("g").cast("string")).alias("alias"), "address", F.lit(R.GROUP_TYPE).alias("type"))).alias("doc"))
    )
    return R.read_group_members(R.parse_device_docs(docs))


CAL_SQL = "CASE device WHEN 'bms1' THEN 1.025 WHEN 'bms2' THEN -1.0 ELSE 1.0 END"


@query(
    "calibrated_energy",
    f"""WITH {TEL}, s AS (SELECT *, {CAL_SQL}::DOUBLE AS f FROM tel), p AS (SELECT *, current * f AS i, coalesce(power_explicit * f, voltage * current * f) AS p FROM s),
l AS (SELECT *, (t_us - lag(t_us) OVER w) / 3.6e9 AS dx, lag(i) OVER w AS pi, lag(p) OVER w AS pp FROM p WINDOW w AS (PARTITION BY device ORDER BY ts, event_id))
SELECT device, round(-sum(CASE WHEN dx <= 1 THEN dx * (pi + i) / 2 ELSE 0 END), 6) + 0.0 AS total_charge, round(-sum(CASE WHEN dx <= 1 THEN dx * (pp + p) * 0.001 / 2 ELSE 0 END), 6) + 0.0 AS total_energy,
       round(sum(CASE WHEN dx <= 1 THEN dx * (greatest(pp, 0) + greatest(p, 0)) * 0.001 / 2 ELSE 0 END), 6) + 0.0 AS total_energy_discharge,
       round(sum(CASE WHEN dx <= 1 THEN dx * (abs(least(pp, 0)) + abs(least(p, 0))) * 0.001 / 2 ELSE 0 END), 6) + 0.0 AS total_energy_charge
FROM l GROUP BY device""",
)
def calibrated_energy(spark, sf_dir):
    """Calibration before the directional meters, inversion of published values before the net meters."""
    df = samples(spark, sf_dir).withColumn("power", F.col("power_explicit"))
    df = J.calibrated(J.with_device(df, device_table(spark, sf_dir)))
    df = df.withColumn("power", F.coalesce("power", F.col("voltage") * F.col("current")))
    t = M.meter_totals(M.meter_increments(df, GAP_S, invert=True))
    return t.select("device", *[r6(c).alias(c) for c in ("total_charge", "total_energy", "total_energy_discharge", "total_energy_charge")])


@query(
    "calibrated_samples",
    f"""WITH {TEL} SELECT event_id, device, round(current * {CAL_SQL}, 6) + 0.0 AS current, round(power_explicit * {CAL_SQL}, 6) + 0.0 AS power, round(-(current * {CAL_SQL}), 6) + 0.0 AS published_current FROM tel""",
)
def calibrated_samples(spark, sf_dir):
    df = samples(spark, sf_dir).withColumn("power", F.col("power_explicit"))
    df = J.calibrated(J.with_device(df, device_table(spark, sf_dir)))
    return df.select("event_id", "device", r6("current").alias("current"), r6("power").alias("power"), r6(invert("current")).alias("published_current"))


@query(
    "device_addresses",
    """WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'C0:' || s_suppkey ELSE s_name END AS address FROM supplier),
d AS (SELECT trim(s_name) AS name, min('D0:' || s_suppkey) AS found FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1)
SELECT s_suppkey, coalesce(found, address) AS address FROM s LEFT JOIN d ON trim(address) = name""",
)
def device_addresses(spark, sf_dir):
    """Entries may give a name instead of an address; only some devices have been discovered."""
    sup = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key = F.col("s_suppkey").cast("string")
    entries = sup.select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("C0:"), key)).otherwise(F.col("s_name")).alias("address"))
    found = sup.filter("s_suppkey % 2 = 0").select(F.concat(F.lit("  "), "s_name").alias("name"), F.concat(F.lit("D0:"), key).alias("address"))
    return J.resolve_addresses(entries, found)


@query(
    "ambient_asof",
    f"""WITH {TEL}, s AS (SELECT event_id, device, ts FROM tel WHERE event_type NOT IN ('view', 'signup')),
r AS (SELECT ts, k FROM tel WHERE event_type = 'view'), o AS (SELECT ts, k / 2.0::DOUBLE AS v FROM tel WHERE event_type = 'signup')
SELECT s.event_id, s.device, CASE WHEN epoch_us(s.ts) - epoch_us(r.ts) <= 600000000 THEN r.k::DOUBLE END AS room, CASE WHEN epoch_us(s.ts) - epoch_us(o.ts) <= 600000000 THEN o.v END AS outdoor
FROM s ASOF LEFT JOIN r ON s.ts >= r.ts ASOF LEFT JOIN o ON s.ts >= o.ts""",
)
def ambient_asof(spark, sf_dir):
    df = samples(spark, sf_dir)
    return J.asof_ambient(pack_samples(df), ambient(df)).select("event_id", "device", "room", "outdoor")


def ambient(df):
    channel = F.when(F.col("event_type") == "view", "room").when(F.col("event_type") == "signup", "outdoor")
    payload = F.when(F.col("event_type") == "view", F.col("k").cast("string")).otherwise(
        F.concat(F.lit('{"state": "'), (F.col("k") / 2.0).cast("string"), F.lit('"}'))
    )
    return df.filter("event_type IN ('view', 'signup')").select(
        channel.alias("channel"), "ts", "event_id", R.parse_ambient(payload).alias("value")
    )


def pack_samples(df):
    return df.filter("event_type NOT IN ('view', 'signup')").select("event_id", "device", "ts", "mos_temperature")


@query(
    "settings_context",
    f"""WITH {TEL}, s AS (SELECT event_id, device, ts, charge FROM tel WHERE event_type <> 'signup'), c AS (SELECT device, ts, 100.0::DOUBLE + k AS capacity, sw_charge FROM tel WHERE event_type = 'signup')
SELECT s.event_id, s.device, s.charge, c.capacity, c.sw_charge AS charge_on FROM s ASOF LEFT JOIN c ON s.device = c.device AND s.ts >= c.ts""",
)
def settings_context(spark, sf_dir):
    """Status rows read with the settings that were in force."""
    df = samples(spark, sf_dir)
    status = df.filter("event_type <> 'signup'").select("event_id", "device", "ts", "charge")
    settings = df.filter("event_type = 'signup'").select("event_id", "device", "ts", (100.0 + F.col("k")).alias("capacity"), F.col("switches")["charge"].alias("charge_on"))
    return J.asof_context(status, settings, ("capacity", "charge_on")).drop("ts")


@query(
    "slow_fields",
    f"""WITH {TEL}, s AS (SELECT event_id, device, ts, CASE WHEN event_id % 3 = 0 THEN mos_temperature END AS t FROM tel WHERE event_type <> 'view'), c AS (SELECT device, ts, k::DOUBLE AS t FROM tel WHERE event_type = 'view')
SELECT s.event_id, s.device, round(coalesce(s.t, CASE WHEN epoch_us(s.ts) - epoch_us(c.ts) <= 3600000000 THEN c.t END), 6) + 0.0 AS mos_temperature FROM s ASOF LEFT JOIN c ON s.device = c.device AND s.ts >= c.ts""",
)
def slow_fields(spark, sf_dir):
    df = samples(spark, sf_dir)
    fast = df.filter("event_type <> 'view'").select("event_id", "device", "ts", F.when(F.col("event_id") % 3 == 0, F.col("mos_temperature")).alias("mos_temperature"))
    slow = df.filter("event_type = 'view'").select("event_id", "device", "ts", F.col("k").cast("double").alias("mos_temperature"))
    out = J.fill_slow_fields(fast, slow, ("mos_temperature",), 3600.0)
    return out.select("event_id", "device", r6("mos_temperature").alias("mos_temperature"))


@query(
    "membership_errors",
    """WITH m AS (SELECT 'dev' || (p_partkey % 50) AS member, 'grp' || p_size AS grp FROM part), d AS (SELECT 'dev' || (s_suppkey % 40) AS device FROM supplier)
SELECT DISTINCT 'unknown_member' AS error, member AS name, grp AS detail FROM m WHERE member NOT IN (SELECT device FROM d)
UNION ALL SELECT 'multiple_groups', member, min(grp) FROM m GROUP BY member HAVING count(DISTINCT grp) > 1
UNION ALL SELECT 'duplicate_name', device, CAST(count(*) AS VARCHAR) FROM d GROUP BY device HAVING count(*) > 1""",
)
def membership_errors(spark, sf_dir):
    members = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.concat(F.lit("dev"), (F.col("p_partkey") % 50).cast("string")).alias("member"), F.concat(F.lit("grp"), F.col("p_size").cast("string")).alias("group")
    ).distinct()
    devices = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("dev"), (F.col("s_suppkey") % 40).cast("string")).alias("device"))
    return J.membership_errors(members, devices)


TICK_S = 3600
ALIGN_SQL = f"""mem(grp, member, ord) AS (VALUES ('g0', 'bms0', 0), ('g0', 'bms1', 1), ('g1', 'bms2', 0), ('g1', 'bms3', 1)),
bounds AS (SELECT grp, max(lo) AS lo, max(hi) AS hi FROM (SELECT grp, member, min(cast(ceil(t_us / 3.6e9) AS BIGINT)) AS lo, max(cast(ceil(t_us / 3.6e9) AS BIGINT)) AS hi FROM tel JOIN mem ON device = member GROUP BY ALL) GROUP BY grp),
ticks AS (SELECT grp, member, ord, unnest(generate_series(lo, hi)) * {TICK_S} AS tick FROM bounds JOIN mem USING (grp)),
al AS (SELECT t.grp, t.member, t.ord, t.tick, x.* FROM (SELECT *, tick * 1000000 AS tick_us FROM ticks) t ASOF JOIN tel x ON t.member = x.device AND t.tick_us >= x.t_us)"""


@query(
    "group_align",
    f"""WITH {TEL}, {ALIGN_SQL} SELECT grp AS "group", member, CAST(ord AS INTEGER) AS ord, tick, event_id FROM al""",
)
def group_align(spark, sf_dir):
    df = samples(spark, sf_dir).select("device", "ts", "event_id")
    return G.align_group(df, member_table(spark, sf_dir), TICK_S).select("group", "member", "ord", "tick", "event_id")


@query(
    "group_rollup",
    f"""WITH {TEL}, {ALIGN_SQL}
SELECT grp AS "group", tick, round(avg(voltage), 6) + 0.0 AS voltage, round(sum(current), 6) + 0.0 AS current, round(sum(coalesce(power_explicit, voltage * current)), 6) + 0.0 AS power, sum(charge) AS charge, sum(capacity) AS capacity,
       round(sum(soc * capacity) / sum(capacity), 6) + 0.0 AS soc, CASE WHEN count(CASE WHEN k % 10 <> 0 THEN k END) = count(*) THEN sum(k)::DOUBLE END AS aged_capacity, round(max(mos_temperature), 6) + 0.0 AS mos_temperature,
       epoch_us(min(ts)) AS ts_us, array_to_string(flatten(list(cell_mv ORDER BY ord)), ',') AS cells, array_to_string(list(k ORDER BY ord), ',') AS temps, arg_max(sw_charge, ord) AS charge_on, arg_max(sw_discharge, ord) AS discharge_on
FROM al GROUP BY grp, tick""",
)
def group_rollup(spark, sf_dir):
    df = samples(spark, sf_dir).select(
        "device", "ts", "event_id", "voltage", "current", F.coalesce("power_explicit", F.col("voltage") * F.col("current")).alias("power"), "charge", "capacity", "soc",
        F.when(F.col("k") % 10 != 0, F.col("k").cast("double")).alias("aged_capacity"), "mos_temperature", "cell_mv", F.array(F.col("k").cast("double")).alias("temperatures"), "switches",
    )
    out = G.group_samples(df, member_table(spark, sf_dir), TICK_S)
    return out.select(
        F.col("device").alias("group"), "tick", *[r6(c).alias(c) for c in ("voltage", "current", "power", "charge", "capacity", "soc", "aged_capacity", "mos_temperature")],
        F.unix_micros("ts").alias("ts_us"), F.array_join(F.col("cell_mv").cast("array<string>"), ",").alias("cells"),
        F.array_join(F.transform("temperatures", lambda t: t.cast("int").cast("string")), ",").alias("temps"),
        F.col("switches")["charge"].alias("charge_on"), F.col("switches")["discharge"].alias("discharge_on"),
    )


@query(
    "group_energy",
    f"""WITH {TEL}, {ALIGN_SQL}, g AS (SELECT grp, tick, sum(coalesce(power_explicit, voltage * current)) AS p, min(t_us) AS t_us FROM al GROUP BY grp, tick),
l AS (SELECT grp, (tick - lag(tick) OVER w) / 3600.0::DOUBLE AS dx, p, lag(p) OVER w AS q FROM g WINDOW w AS (PARTITION BY grp ORDER BY tick))
SELECT grp AS device, round(sum(CASE WHEN dx <= 1 THEN dx * (p + q) * 0.001 / 2 ELSE 0 END), 6) + 0.0 AS total_energy FROM l GROUP BY grp""",
)
def group_energy(spark, sf_dir):
    """The meters of a group run on its own rows, on the group's clock."""
    df = samples(spark, sf_dir).select("device", "ts", "event_id", "voltage", "current", F.coalesce("power_explicit", F.col("voltage") * F.col("current")).alias("power"), "charge", "capacity", "soc")
    rows = G.group_samples(df, member_table(spark, sf_dir), TICK_S).withColumn("ts", F.timestamp_seconds("tick")).withColumn("event_id", F.col("tick"))
    return M.meter_totals(M.meter_increments(rows, GAP_S)).select("device", r6("total_energy").alias("total_energy"))


@query(
    "group_commands",
    f"""WITH {TEL}, mem(grp, member) AS (VALUES ('g0', 'bms0'), ('g0', 'bms1'), ('g1', 'bms2'), ('g1', 'bms3')),
c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'g' || (event_id % 2) ELSE device END AS device, sw_charge AS value FROM tel)
SELECT event_id, device, coalesce(member, device) AS target, value FROM c LEFT JOIN mem ON device = grp""",
)
def group_commands(spark, sf_dir):
    cmd = samples(spark, sf_dir).select(
        "event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("g"), (F.col("event_id") % 2).cast("string"))).otherwise(F.col("device")).alias("device"),
        F.col("switches")["charge"].alias("value"),
    )
    return J.expand_group_commands(cmd, member_table(spark, sf_dir))


@query(
    "classify_protocol",
    """WITH f AS (SELECT event_id, lower((['DD', '55AAEB', 'A501', 'AA55', 'AA55AA', '7E', '7B', '01'])[event_id % 8 + 1] || printf('%04X', event_id % 65536) || (CASE WHEN event_id % 3 = 0 THEN '' ELSE '00' END) || (['77', '0D', '7D'])[event_id % 3 + 1]) AS h FROM events),
s(family, head, tail) AS (VALUES ('braunpwr', '7b', '7d'), ('jbd / supervolt', 'dd', '77'), ('jk', '55aaeb', ''), ('daly', 'a501', ''), ('neey', 'aa5511', ''), ('cbtpwr', 'aa55', '0d'), ('tdt / seplos_v2 / cbtpwr_vb', '7e', '0d'), ('ant_leg', 'aa55aa', ''))
SELECT event_id, family FROM f JOIN s ON length(h) >= 8 AND h LIKE head || '%' AND h LIKE '%' || tail""",
)
def classify_protocol(spark, sf_dir):
    e = F.col("event_id")
    heads = F.array(*[F.lit(h) for h in ("DD", "55AAEB", "A501", "AA55", "AA55AA", "7E", "7B", "01")])
    tails = F.array(*[F.lit(t) for t in ("77", "0D", "7D")])
    text = F.concat(F.get(heads, (e % 8).cast("int")), F.format_string("%04X", e % 65536), F.when(e % 3 == 0, "").otherwise("00"), F.get(tails, (e % 3).cast("int")))
    frames = events(spark, sf_dir).select("event_id", F.unhex(text).alias("frame"))
    return J.classify_protocol(frames).select("event_id", "family")
