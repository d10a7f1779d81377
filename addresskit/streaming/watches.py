"""Log watches as streaming window aggregates (ST2, ST3, ST5), and the run of a watch into files.

Windows close at the watermark (append mode). Top lists come from a sketch per window that holds TRACKED items: exact as
long as a window has fewer, and of fixed size however many names or addresses an attack brings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WATERMARK = "10 minutes"
TOP = 10
ASKED = 1000  # more than are listed, so that ties at the end of the list fall by item
TRACKED = 10_000


def _top(item: str) -> Column:
    return F.call_function("approx_top_k", F.col(item), F.lit(ASKED), F.lit(TRACKED))


def _listed(top: Column) -> Column:
    """``item:count|...``, the greatest count first, ties by item."""
    ordered = F.sort_array(F.transform(top, lambda x: F.struct((-x["count"]).alias("c"), x["item"].alias("i"))))
    return F.array_join(F.transform(F.slice(ordered, 1, TOP), lambda x: F.concat_ws(":", x["i"], (-x["c"]).cast("string"))), "|")


def error_burst_watch(requests: DataFrame, more_than: int, watermark: str = WATERMARK) -> DataFrame:
    """ST2 of a stream of ``ts timestamp, status_code, error_name``: 5 minutes every minute, top error names."""
    e = requests.withWatermark("ts", watermark).where("status_code >= 400")
    w = e.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n_errors"), _top("error_name").alias("top"))
    named = F.filter("top", lambda x: x["item"].isNotNull())
    return w.where(F.col("n_errors") > more_than).select(F.col("w.start").alias("window_start"), "n_errors", _listed(named).alias("top_error_names"))


def slow_call_watch(requests: DataFrame, windows, watermark: str = WATERMARK) -> DataFrame:
    """ST3 of a stream of ``ts timestamp, duration_ms``, with the windows of the batch report."""
    return windows(requests.withWatermark("ts", watermark))


def security_watch(hits: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """ST5 of a stream of ``ts timestamp, event, ip``: 2 minutes every 30 seconds, top events and addresses."""
    w = hits.withWatermark("ts", watermark).groupBy(F.window("ts", "2 minutes", "30 seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("n_events"), _top("event").alias("events"), _top("ip").alias("ips"))
    return w.select(F.col("w.start").alias("window_start"), "n_events", _listed(F.col("events")).alias("top_events"),
                    _listed(F.col("ips")).alias("top_ips"))


def into_files(result: DataFrame, out: str, available_now: bool = True):
    """Starts the stream into Parquet files (exactly once: the file sink's log and the checkpoint)."""
    w = result.writeStream.outputMode("append").format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/_checkpoint")
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()
