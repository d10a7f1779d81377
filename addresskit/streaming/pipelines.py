"""Structured Streaming jobs that write tables (ST1, ST15).

Sources are directories of files (new files = new data); every query runs
with a checkpoint location in the shared folder and can be run with
``trigger(availableNow=True)`` to process what is there and stop, or with a
processing-time trigger as a long-running job. Event-time aggregations carry
an explicit watermark (the reference polls stored logs and has none).
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.snapshots import SnapshotTable
from .stateful import use_rocksdb
from .stitching import log_events

# Fixed value: a log that is silent for so long (seconds) has its last event put out.
FLUSH_S = 5
# A run over what is there takes it in so many batches, of so many files at least.
BACKLOG, LEAST_FILES = 2, 8


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream run (sink + checkpoint) under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def backlog_files(spark: SparkSession, source: str) -> int:
    """Files per batch with which what is under ``source`` is taken in BACKLOG batches, however many files it has."""
    return max(LEAST_FILES, math.ceil(len(spark.read.text(source).inputFiles()) / BACKLOG))


# ------------------------------------------------------------------ ST1 + S21
def route_logs(batch: DataFrame, epoch: int, out: str) -> None:
    """A batch into the daily logs, its high and critical events into the alerts. Each epoch owns a folder that
    it overwrites, so a retried batch replaces its rows."""
    hot = batch.filter(F.col("alert_priority").isin("high", "critical"))
    for rows, sink in ((batch, "logs"), (hot, "alerts")):
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{out}/{sink}/epoch={epoch}")


def ingest_logs(spark: SparkSession, source: str, out: str, parse, available_now: bool = True):
    """ST1: log files -> whole events (S20) -> parsed events; S21: daily log sink plus a copy of high/critical events.

    A running stream puts out the last event of a silent log after FLUSH_S; a run over what is there leaves it open for the next.
    """
    use_rocksdb(spark)
    e = log_events(spark, source, backlog_files(spark, source) if available_now else 1, None if available_now else FLUSH_S).where(F.col("first").isNotNull())
    parsed = parse(e.select("file", F.lit(None).cast("long").alias("line_no"), F.col("first").alias("line"), F.col("rest").alias("stack")))
    parsed = parsed.withColumn("day", F.to_date("ts"))

    def route(batch: DataFrame, epoch: int) -> None:
        batch.persist()  # both sinks read it
        try:
            route_logs(batch, epoch, out)
        finally:
            batch.unpersist()

    w = parsed.writeStream.foreachBatch(route).option("checkpointLocation", f"{out}/_checkpoint")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


# ------------------------------------------------------------------ ST15 register refresh
def register_refresh_stream(spark: SparkSession, source: str, schema, geocodes: DataFrame, localities: DataFrame,
                            streets: DataFrame, table: SnapshotTable, layout, out: str, as_of_date: str):
    """ST15: new address-detail files -> load transform -> upsert into the stored register, a snapshot per batch.

    Only the partitions that a batch touches are rewritten; the files that are there are taken in BACKLOG batches, so the whole
    register is not rewritten for every few files. A batch's snapshot has the batch's number and starts from the one
    before it, so a retried batch replaces its own; of two rows of a key in a batch the later by file and place counts.
    """
    from ..operators import register as R

    raw = spark.readStream.schema(schema).option("header", True).option("sep", "|") \
        .option("maxFilesPerTrigger", backlog_files(spark, source)).csv(source)
    raw = raw.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).alias("_came"))
    upd = ["formatted_address", "confidence_score", "completeness_score"]

    def apply(batch: DataFrame, epoch: int) -> None:
        b = batch.withColumn("date_created", F.col("date_created").try_cast("date"))
        came = b.select("address_detail_pid", F.struct("_came.file", "_came.block", F.monotonically_increasing_id().alias("row")).alias("came"))
        came = came.groupBy("address_detail_pid").agg(F.max("came").alias("came"))
        last = b.select("*", F.struct("_came.file", "_came.block", F.monotonically_increasing_id().alias("row")).alias("came"))
        last = last.join(came, ["address_detail_pid", "came"], "left_semi").drop("_came", "came")
        rows = layout(R.load_addresses(last, geocodes, localities, streets, as_of_date=as_of_date)).withColumn("_order", F.lit(0))
        rows.persist()  # its keys are read first, then its rows
        try:
            table.upsert(rows, "address_detail_pid", upd, "_order", version=epoch)
        finally:
            rows.unpersist()

    return (raw.writeStream.foreachBatch(apply).option("checkpointLocation", f"{out}/_checkpoint")
            .trigger(availableNow=True).start())
