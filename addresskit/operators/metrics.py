"""Metric building blocks for request logs.

Skew-aware formulations:

* exact percentiles from a value histogram: ``groupBy(keys, value).count()``
  (map-side combine), then a running count per key over the *distinct*
  values; a hot key costs one row per distinct value, not one per request.
* sequence windows (moving average of the last N calls, EMA) need a global
  position per key. It is built from (key, time chunk) row numbers plus
  chunk offsets; the moving average then runs over fixed-size blocks of
  positions with an (N-1)-row halo copied from the previous block, and the
  EMA over blocks that start from a carried value.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float],
                      mode: str = "floor") -> DataFrame:
    """Per-key exact percentiles.

    ``floor``: 0-based index floor(n*q) of the sorted values (request stats).
    ``ceil``: nearest rank, index ceil(n*q)-1 floored at 0 (load-test stats).
    """
    keys = list(keys)
    h = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    w_run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumn("_cum", F.sum("_c").over(w_run)).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    aggs = []
    for name, q in qs.items():
        if mode == "floor":
            target = F.floor(F.col("_n") * q) + 1
        else:
            target = F.greatest(F.ceil(F.col("_n") * q), F.lit(1))
        aggs.append(F.min(F.when(F.col("_cum") >= target, F.col(value))).alias(name))
    return h.groupBy(*keys).agg(*aggs)


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column) -> DataFrame:
    """1-based position ``_g`` of each row within its key, by ``order``.

    Row numbers are taken per (key, chunk) and shifted by the sizes of the
    key's earlier chunks (a small table: one row per key and chunk).
    """
    keys = list(keys)
    d = df.withColumn("_chunk", chunk)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    d = d.withColumn("_rn", F.row_number().over(w))
    sizes = d.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_size"))
    wo = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_size").over(wo), F.lit(0))).drop("_size")
    return d.join(sizes, [*keys, "_chunk"]).withColumn("_g", F.col("_rn") + F.col("_off")).drop(
        "_rn", "_off", "_chunk")


def with_halo(df: DataFrame, halo: int, block: int) -> DataFrame:
    """Block rows by position; each row is also copied into the later blocks whose first ``halo``
    predecessors it belongs to (one copy when ``halo <= block``)."""
    b = F.floor((F.col("_g") - 1) / block)
    own = df.withColumn("_block", b).withColumn("_halo", F.lit(False))
    last_needed = F.floor((F.col("_g") - 1 + halo) / block)
    tail = df.filter(last_needed > b).withColumn(
        "_block", F.explode(F.sequence(b + 1, last_needed))).withColumn("_halo", F.lit(True))
    return own.unionByName(tail)


def moving_average(df: DataFrame, keys: Sequence[str], value: str, n: int, block: int = 10000) -> DataFrame:
    """Mean of the last ``n`` values per key (needs ``_g`` from ``positions``)."""
    h = with_halo(df, n - 1, block)
    w = Window.partitionBy(*keys, "_block").orderBy("_g").rowsBetween(-(n - 1), 0)
    return h.withColumn("moving_avg", F.avg(value).over(w)).filter(~F.col("_halo")).drop("_block", "_halo")


def ema(df: DataFrame, keys: Sequence[str], value: str, alpha: float = 0.2, seed: float | None = None,
        block: int = 100_000) -> DataFrame:
    """e = (1-alpha) e + alpha x over each key's whole history (needs ``_g`` from ``positions``).

    Without ``seed`` the first value starts the average, else e starts at ``seed``. A full block maps the average
    before it to (1-alpha)^block e + add; ``add`` is a plain sum, the averages at the block starts are carried over
    one row per block, and each block then runs from its own start. Values must not be null.
    """
    keys, keep = list(keys), 1.0 - alpha
    d = df.withColumn("_block", F.floor((F.col("_g") - 1) / block))
    weight = F.lit(alpha) * F.pow(F.lit(keep), block - 1 - (F.col("_g") - 1) % block)
    if seed is None:
        weight = F.when(F.col("_g") == 1, F.pow(F.lit(keep), F.lit(block - 1))).otherwise(weight)
    adds = d.groupBy(*keys, "_block").agg(F.sum(weight * F.col(value)).alias("_add"))

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block")
        e, starts = seed or 0.0, []
        for add in pdf["_add"]:
            starts.append(e)
            e = keep ** block * e + add
        return pdf.drop(columns="_add").assign(_start=starts)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_g")
        x = pdf[value].astype("float64")
        if seed is None and pdf["_block"].iloc[0] == 0:
            e = x.ewm(alpha=alpha, adjust=False).mean()
        else:
            e = pd.concat([pdf["_start"].iloc[:1], x]).ewm(alpha=alpha, adjust=False).mean().iloc[1:]
        return pdf.drop(columns=["_block", "_start"]).assign(ema=e.to_numpy())

    key_types = [T.StructField(k, df.schema[k].dataType) for k in keys]
    starts = adds.groupBy(*keys).applyInPandas(carry, T.StructType(
        [*key_types, T.StructField("_block", T.LongType()), T.StructField("_start", T.DoubleType())]))
    return d.join(starts, [*keys, "_block"]).select(*df.columns, "_block", "_start").groupBy(*keys, "_block").applyInPandas(
        run, T.StructType([*df.schema.fields, T.StructField("ema", T.DoubleType())]))


def cumulative_histogram(df: DataFrame, keys: Sequence[str], value: Column, bounds: Sequence[float]) -> DataFrame:
    """Cumulative ``le`` bucket counts per key: one ``count_if`` per bound, then stacked."""
    aggs = [F.count_if(value <= b).alias(f"_le{i}") for i, b in enumerate(bounds)]
    aggs.append(F.count(F.lit(1)).alias("_inf"))
    h = df.groupBy(*keys).agg(*aggs)
    pairs = ", ".join(f"CAST({b!r} AS DOUBLE), _le{i}" for i, b in enumerate(bounds))
    stack = f"stack({len(bounds) + 1}, {pairs}, CAST('Infinity' AS DOUBLE), _inf) AS (le, cumulative_count)"
    return h.select(*keys, F.expr(stack))


def histogram_quantile(hist: DataFrame, keys: Sequence[str], q: float) -> DataFrame:
    """Linear interpolation inside the first bucket whose cumulative count reaches q * total."""
    w = Window.partitionBy(*keys).orderBy("le")
    h = hist.withColumn("_prev_le", F.coalesce(F.lag("le").over(w), F.lit(0.0))) \
        .withColumn("_prev_cum", F.coalesce(F.lag("cumulative_count").over(w), F.lit(0))) \
        .withColumn("_total", F.max("cumulative_count").over(Window.partitionBy(*keys)))
    h = h.withColumn("_rank", F.lit(q) * F.col("_total"))
    first = h.filter((F.col("cumulative_count") >= F.col("_rank")) & (F.col("_total") > 0)) \
        .withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1)
    interp = F.col("_prev_le") + (F.col("le") - F.col("_prev_le")) * (F.col("_rank") - F.col("_prev_cum")) / (
        F.col("cumulative_count") - F.col("_prev_cum"))
    val = F.when(F.col("le") == float("inf"), F.col("_prev_le")).otherwise(interp)
    return first.select(*keys, val.alias("quantile"))


def epoch_s(ts: Column | str) -> Column:
    """Whole seconds since 1970-01-01 of a wall-clock timestamp (independent of the session zone)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a wall-clock timestamp."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def islands(df: DataFrame, keys: Sequence[str], ts: str, cond: str, step_s: int, hold_s: int) -> DataFrame:
    """Runs of consecutive true ``cond`` buckets lasting at least ``hold_s``; fires at start + hold."""
    w = Window.partitionBy(*keys).orderBy(ts)
    d = df.withColumn("_prev", F.lag(cond).over(w)).withColumn(
        "_prev_ts", F.lag(ts).over(w))
    gap = (F.col("_prev_ts").isNull() | (epoch_s(ts) - epoch_s("_prev_ts") > step_s)
           | (F.col("_prev") != F.col(cond)))
    d = d.withColumn("_island", F.sum(gap.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = d.filter(F.col(cond)).groupBy(*keys, "_island").agg(
        F.min(ts).alias("start"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("buckets"))
    held = (epoch_s("last") + step_s - epoch_s("start")) >= hold_s
    return runs.filter(held).select(
        *keys, "start", "last", "buckets",
        (F.col("start") + F.make_dt_interval(secs=F.lit(hold_s))).alias("fires_at"))
