"""Telemetry views over the `events` table: one row is one reading of one battery.

The mapping is the one of FIXTURES.md section 1. `TEL` is the same mapping as a SQL common table
expression, used at the head of every oracle text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

N_CELLS = 4


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_samples(events(spark, sf_dir))


def sample_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same view as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", 64).parquet(sf_dir)
    return as_samples(raw.withColumn("ts", F.col("ts").cast("timestamp")))


def as_samples(log: DataFrame) -> DataFrame:
    """`events` rows, batch or stream, as samples."""
    eid = F.col("event_id")
    cells = [(F.lit(2600) + (eid * (7 + 2 * i) + 131 * i) % 1000).cast("int") for i in range(N_CELLS)]
    return log.select(
        "event_id",
        F.concat(F.lit("bms"), (F.col("user_id") % 4).cast("string")).alias("device"),
        "ts",
        (F.col("ts") + F.make_interval(secs=(eid % 50).cast("decimal(18,6)"))).alias("ingest_ts"),
        "event_type",
        "value",
        _k().alias("k"),
        ((F.col("value") - 50) / 10).alias("current"),
        (48 + _k() / 20.0).alias("voltage"),
        F.when(F.col("event_type") == "purchase", F.col("value") * 10).alias("power_explicit"),
        _k().cast("double").alias("soc"),
        _k().cast("double").alias("charge"),
        F.lit(100.0).alias("capacity"),
        (15 + F.col("value") / 10).alias("mos_temperature"),
        F.when(F.col("event_type") == "error", _k().cast("long")).otherwise(F.lit(0).cast("long")).alias("problem_code"),
        F.create_map(
            F.lit("charge"), eid % 3 != 0,
            F.lit("discharge"), eid % 5 != 0,
        ).alias("switches"),
        F.array(*cells).alias("cell_mv"),
    )


TEL = """tel AS (
  SELECT event_id, ts, epoch_us(ts) AS t_us, 'bms' || (user_id % 4) AS device,
         ts + to_seconds(event_id % 50) AS ingest_ts, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         (value - 50) / 10 AS current,
         48 + CAST(json_extract_string(props, '$.k') AS INTEGER) / 20.0::DOUBLE AS voltage,
         CASE WHEN event_type = 'purchase' THEN value * 10 END AS power_explicit,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS soc,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS charge,
         CAST(100.0 AS DOUBLE) AS capacity,
         15 + value / 10 AS mos_temperature,
         CASE WHEN event_type = 'error' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) ELSE 0 END AS problem_code,
         event_id % 3 <> 0 AS sw_charge, event_id % 5 <> 0 AS sw_discharge,
         [CAST(2600 + (event_id * 7) % 1000 AS INTEGER), CAST(2600 + (event_id * 9 + 131) % 1000 AS INTEGER),
          CAST(2600 + (event_id * 11 + 262) % 1000 AS INTEGER), CAST(2600 + (event_id * 13 + 393) % 1000 AS INTEGER)] AS cell_mv
  FROM events)"""


#: configuration of the four monitored packs, in the layout of the monitor's options document
OPTIONS = {
    "devices": [
        {"alias": "bms0", "address": "C0:00:00:00:00:00", "type": "jbd", "current_calibration": 1.0, "algorithm": "soc 90% 70%"},
        {"alias": "bms1", "address": "C0:00:00:00:00:01", "type": "jk:v2", "current_calibration": 1.025, "algorithm": "soc 90% 70%"},
        {"alias": " bms2 ", "address": " C0:00:00:00:00:02", "type": "daly", "current_calibration": -1.0, "algorithm": "soc 90% 70%"},
        {"alias": "bms3", "address": "C0:00:00:00:00:03", "type": "ant", "algorithm": "soc 90% 70%; soc 80%"},
        {"alias": "g0", "address": "bms0,bms1", "type": "group_parallel"},
        {"alias": "g1", "address": "bms2,,bms3,bms2", "type": "group_parallel"},
        {"alias": "off", "address": "#C0:00:00:00:00:09", "type": "jbd"},
        {"alias": "none", "address": "", "type": "jbd"},
    ]
}
