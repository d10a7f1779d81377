"""Alert grouping and repeat suppression (ST12) in batch.

Alerts are grouped by alert and service. Of one window the highest severity counts. A window opens an episode if the group
was silent for more than STEP_S before it. A window is notified if it opens an episode, if it is more severe than the last
one notified, or if the repeat interval of its severity has passed since then. The next notification after a window depends
on that window alone, so the notified windows are found by pointers, not by walking each group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from .pointers import cut, first_at_or_after, reachable
from .quota import running_count

# Severities from the least to the greatest; repeat interval of each (seconds), one hour for the others.
SEVERITIES = ["info", "warning", "error", "critical"]
REPEAT_S = {"critical": 300, "warning": 1800, "info": 43200}
DEFAULT_REPEAT_S = 3600
STEP_S = 300
GROUP = ("alert_type", "service")
DAY_US = 86_400_000_000


def repeat_us(rank: int) -> int:
    name = SEVERITIES[rank - 1] if rank else None
    return 1_000_000 * REPEAT_S.get(name, DEFAULT_REPEAT_S)


def severity_rank(severity: Column) -> Column:
    """1 (least) upwards; 0 for an unknown or missing severity."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity), F.lit(0)).cast("int")


def severity_name(rank: Column) -> Column:
    return F.when(rank > 0, F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), rank))


def windows(alerts: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """One row per group and window: ``keys, window_start, t`` (microseconds), ``rank`` of the highest severity."""
    a = alerts.select(*[F.coalesce(k, F.lit("")).alias(k) for k in keys], "window_start", severity_rank(F.col("severity")).alias("rank"))
    return a.groupBy(*keys, "window_start").agg(F.max("rank").alias("rank")).withColumn("t", M.micros("window_start"))


def notifications(alerts: DataFrame, keys: Sequence[str] = GROUP, step_s: int = STEP_S, chunk_us: int = DAY_US) -> DataFrame:
    """``keys, severity, window_start, notified, episode`` (from 1 in each group) of alerts with a severity and a start."""
    keys = list(keys)
    chunk = F.floor(F.col("t") / chunk_us)
    p = M.positions(windows(alerts, keys), keys, ["t"], chunk).withColumnRenamed("_g", "g")
    p = cut(p)
    before = p.select(*keys, (F.col("g") + 1).alias("g"), F.col("t").alias("_before"))
    opens = F.col("_before").isNull() | (F.col("t") - F.col("_before") > step_s * 1_000_000)
    p = p.join(before, [*keys, "g"], "left").withColumn("opens", opens.cast("int")).drop("_before")
    p = cut(running_count(p, keys, ["g"], chunk, "opens").withColumnRenamed("_count", "episode"))

    # a row stands in the class of its severity and in "at least" of every severity up to it
    ranks = range(len(SEVERITIES) + 1)
    classes = F.concat(F.array(F.concat(F.lit("is"), "rank")),
                       F.transform(F.sequence(F.lit(0), F.col("rank")), lambda r: F.concat(F.lit("from"), r)))
    rows = p.select(*keys, F.explode(classes).alias("of"), "g", "t")
    asks = [F.struct(F.lit(f"is{r}").alias("of"), (F.col("t") + F.lit(repeat_us(r))).alias("t")) for r in ranks]
    asks.append(F.struct(F.concat(F.lit("from"), F.col("rank") + 1).alias("of"), (F.col("t") + 1).alias("t")))
    probes = p.select(*keys, F.col("g").alias("src"), F.explode(F.array(*asks)).alias("a")).select(*keys, "src", "a.of", "a.t")
    after = first_at_or_after(rows, probes, [*keys, "of"], chunk_us).groupBy(*keys, "src").agg(F.min("g").alias("to"))
    inside = p.select(*keys, F.col("g").alias("to"), F.col("episode").alias("_same"))
    after = after.withColumnRenamed("src", "g").join(p.select(*keys, "g", "episode"), [*keys, "g"]).join(inside, [*keys, "to"])
    sent = reachable(p.where("opens = 1").select(*keys, "g"), after.where("episode = _same"), keys)

    out = p.join(sent.withColumn("_sent", F.lit(True)), [*keys, "g"], "left")
    return out.select(*keys, severity_name(F.col("rank")).alias("severity"), "window_start",
                      F.coalesce("_sent", F.lit(False)).alias("notified"), F.col("episode").cast("long").alias("episode"))


def episodes(notified: DataFrame, keys: Sequence[str] = GROUP, step_s: int = STEP_S) -> DataFrame:
    """Each episode: first and last window, when it counts as resolved, windows, notifications, highest severity."""
    g = notified.groupBy(*keys, "episode").agg(
        F.min("window_start").alias("started"), F.max("window_start").alias("last_window"), F.count(F.lit(1)).alias("windows"),
        F.count_if("notified").alias("notifications"), F.max(severity_rank(F.col("severity"))).alias("_rank"))
    return g.select(*keys, "episode", "started", "last_window", (F.col("last_window") + F.make_dt_interval(secs=F.lit(step_s))).alias("resolved"),
                    "windows", "notifications", severity_name(F.col("_rank")).alias("severity"))
