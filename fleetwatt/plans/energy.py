"""Energy reports: the flagship query and the other meter reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwatt.operators import meters as M
from fleetwatt.plans.registry import ORACLES, query, r6
from fleetwatt.plans.telemetry import TEL, samples
from fleetwatt.schema import SAMPLES
from fleetwatt.session import shared_folder
from fleetwatt.sources.readers import read_samples

GAP_S = 3600.0


def powered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).withColumn("power", F.col("voltage") * F.col("current"))


def metered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What meters read; any other column would go through every scan."""
    return powered(spark, sf_dir).select("event_id", "device", "ts", "current", "power", "soc", "charge")


INC = """inc AS (
  SELECT *, CASE WHEN dx <= 1 THEN dx * (pi + current) / 2 ELSE 0 END AS d_charge,
         CASE WHEN dx <= 1 THEN dx * (pp + p) * 0.001 / 2 ELSE 0 END AS d_net,
         CASE WHEN dx <= 1 THEN dx * (greatest(pp, 0) + greatest(p, 0)) * 0.001 / 2 ELSE 0 END AS d_dis,
         CASE WHEN dx <= 1 THEN dx * (abs(least(pp, 0)) + abs(least(p, 0))) * 0.001 / 2 ELSE 0 END AS d_chg,
         CASE WHEN dx <= 1 AND abs(soc * 0.005 - ps * 0.005) <= 0.1 THEN abs(soc * 0.005 - ps * 0.005) ELSE 0 END AS d_cyc,
         CASE WHEN dx <= 1 AND abs(charge - pq) <= 0.5 THEN abs(charge - pq) ELSE 0 END AS d_abs
  FROM (SELECT *, (t_us - lag(t_us) OVER w) / 3.6e9 AS dx, voltage * current AS p,
               lag(voltage * current) OVER w AS pp, lag(current) OVER w AS pi, lag(soc) OVER w AS ps, lag(charge) OVER w AS pq
        FROM tel WINDOW w AS (PARTITION BY device ORDER BY ts, event_id)))"""


@query(
    "energy_meters",
    f"""WITH {TEL}, {INC}
SELECT device, count(*) AS samples, round(sum(d_charge), 6) + 0.0 AS net_charge_ah, round(sum(d_net), 6) + 0.0 AS net_kwh,
       round(sum(d_dis), 6) + 0.0 AS discharge_kwh, round(sum(d_chg), 6) + 0.0 AS charge_kwh,
       round(sum(d_cyc), 6) + 0.0 AS cycles, round(sum(d_abs), 6) + 0.0 AS abs_diff_charge_ah,
       abs(sum(d_net) - (sum(d_dis) - sum(d_chg))) < 1e-6 AS balanced
FROM inc GROUP BY device""",
)
def energy_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six meters per device, with the net = discharge - charge check."""
    return energy_report(powered(spark, sf_dir))


def energy_report(rows: DataFrame) -> DataFrame:
    totals = M.meter_totals(M.meter_increments(rows, GAP_S))
    return M.reconcile_energy(totals).select(
        "device",
        "samples",
        r6("total_charge").alias("net_charge_ah"),
        r6("total_energy").alias("net_kwh"),
        r6("total_energy_discharge").alias("discharge_kwh"),
        r6("total_energy_charge").alias("charge_kwh"),
        r6("total_cycles").alias("cycles"),
        r6("total_abs_diff_charge").alias("abs_diff_charge_ah"),
        "balanced",
    )


@query("canonical_meters", ORACLES["energy_meters"])
def canonical_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report from files in the canonical schema, which has no sequence column, read by the typed reader."""
    have = samples(spark, sf_dir)
    folder = f"{shared_folder(spark)}/samples-{uuid.uuid4().hex}"
    have.select(*[(F.col(f.name) if f.name in have.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SAMPLES]).write.parquet(folder)
    rows = read_samples(spark, folder)
    return energy_report(rows.withColumn("power", F.coalesce("power", F.col("voltage") * F.col("current"))))
