"""Fixed-window request quota (ST13) without collecting a client's requests in one task.

A client's windows start at its first request; a window lasts until its start + W, that moment included, and the next
one starts at the first request after it. With requests numbered 1..n per client (``metrics.positions``), each request points
to the first one after its own time + W; the window starts are what is reached from request 1 (``pointers``), so a
client with a third of all requests is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import metrics as M
from .pointers import cut, first_at_or_after, reachable


def running_count(df: DataFrame, key: str | list[str], order: list[str], chunk, flag: str) -> DataFrame:
    """Per key, the number of rows with ``flag`` = 1 up to and including each row (in ``order``)."""
    keys = [key] if isinstance(key, str) else list(key)
    d = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_run", F.sum(flag).over(w))
    sizes = d.groupBy(*keys, "_chunk").agg(F.sum(flag).alias("_s"))
    wo = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_s").over(wo), F.lit(0))).drop("_s")
    return d.join(sizes, [*keys, "_chunk"]).withColumn("_count", F.col("_run") + F.col("_off")).drop(
        "_run", "_off", "_chunk")


def fixed_windows(requests: DataFrame, key: str, ts_us: str, window_us: int, limit: int,
                  chunk_us: int = 86_400_000_000) -> DataFrame:
    """Assign each request its window start and in-window rank; ``allowed`` = rank <= limit.

    ``requests`` needs ``key``, ``ts_us`` (microseconds) and ``request_id``.
    """
    base = requests.select(key, "request_id", ts_us)
    chunk = F.floor(F.col(ts_us) / chunk_us)
    pos = M.positions(base, [key], [ts_us, "request_id"], chunk)  # _g
    pos = cut(pos)
    probes = pos.select(key, F.col("_g").alias("src"), (F.col(ts_us) + window_us + 1).alias("t"))
    rows = pos.select(key, F.col("_g").alias("g"), F.col(ts_us).alias("t"))
    pointers = first_at_or_after(rows, probes, [key], chunk_us).select(key, F.col("src").alias("g"), F.col("g").alias("to"))
    orbit = reachable(pos.where("_g = 1").select(key, F.col("_g").alias("g")), pointers, [key])
    starts = orbit.withColumn("_start", F.lit(1))
    p = pos.join(starts.withColumnRenamed("g", "_g"), [key, "_g"], "left")
    p = p.withColumn("_start_g", F.when(F.col("_start") == 1, F.col("_g")))
    # last start at or before each request: a running max per (key, chunk) plus the carry from earlier chunks
    d = p.withColumn("_chunk", chunk)
    w = Window.partitionBy(key, "_chunk").orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_ls", F.max("_start_g").over(w))
    cm = d.groupBy(key, "_chunk").agg(F.max("_start_g").alias("_cmax"))
    wo = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    cm = cm.withColumn("_carry", F.max("_cmax").over(wo)).drop("_cmax")
    d = d.join(cm, [key, "_chunk"]).withColumn("window_g", F.coalesce("_ls", "_carry"))
    st = pos.select(key, F.col("_g").alias("window_g"), F.col(ts_us).alias("window_start_us"))
    d = d.join(st, [key, "window_g"])
    rank = F.col("_g") - F.col("window_g") + 1
    return d.select(key, "request_id", ts_us, "window_start_us", rank.alias("rank_in_window"),
                    (rank <= limit).alias("allowed"))
