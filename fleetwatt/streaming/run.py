"""Running streams: bounded batches, checkpoints in the shared folder, catch-up runs."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwatt.operators.meters import METERS
from fleetwatt.session import shared_folder
from fleetwatt.sinks.points import meter_points
from fleetwatt.streaming.folds import ROCKSDB

#: rows of a file at most; files are as large as a batch makes them below that
ROWS_PER_FILE = 5_000_000

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def stream_dir(spark: SparkSession) -> str:
    """A new folder under the folder that driver and executors share."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@contextmanager
def state_partitions(spark: SparkSession):
    """While a stream starts: RocksDB for its state, and at most two partitions per core, as each is a store to open per batch."""
    parts = "spark.sql.shuffle.partitions"
    before = spark.conf.get(parts)
    store = spark.conf.get(STATE_STORE, None)
    spark.conf.set(parts, str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(parts, before)
        if store is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, store)


def catch_up(out: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Process everything there is, append it to `path`, stop, and read the result."""
    writer = out.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with state_partitions(out.sparkSession):
        q = writer.option("checkpointLocation", checkpoint).start(path)
        q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(path)


def run_to_table(out: DataFrame) -> DataFrame:
    folder = stream_dir(out.sparkSession)
    return catch_up(out, f"{folder}/data", f"{folder}/checkpoint")


def split_late(out: DataFrame, path: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """Process everything there is and write what `late` marks to a table of its own: (fresh, late), with the batch that wrote a row.

    A batch that is run again writes the same folders again.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        for name, side in (("fresh", ~F.col("late")), ("late", F.col("late"))):
            batch.filter(side).drop("late").write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")

    with state_partitions(out.sparkSession):
        q = out.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    schema = T.StructType([*out.drop("late").schema.fields, T.StructField("batch", T.LongType())])
    return tuple(out.sparkSession.read.schema(schema).parquet(f"{path}/{name}") for name in ("fresh", "late"))


def batch_append(out: DataFrame, path: str, checkpoint: str, interval: str | None = None, rows_per_file: int = ROWS_PER_FILE):
    """Append points. What a batch holds is bounded by the source's rate (`maxFilesPerTrigger` and the like) and the
    trigger, not by small files. The checkpoint replays a failed batch, which replaces a retry buffer."""
    writer = (
        out.writeStream.format("parquet").outputMode("append")
        .option("maxRecordsPerFile", rows_per_file).option("checkpointLocation", checkpoint)
    )
    return writer.trigger(processingTime=interval).start(path) if interval else writer.trigger(availableNow=True).start(path)


def meter_snapshots(readings: DataFrame, path: str, checkpoint: str, interval: str | None = None):
    """Store the last reading of every 30 seconds and device, from a stream of readings.

    A period that spans two batches is stored once per batch; its later row has the later `batch`.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        meter_points(batch, METERS).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = readings.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    with state_partitions(readings.sparkSession):
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
