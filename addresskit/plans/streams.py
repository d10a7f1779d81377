"""Streaming, episode and quota queries (ST1-ST5, ST12, ST13, ST15): each stream runs to completion, its sink is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logs as L
from ..operators import episodes as EP
from ..operators import metrics as M
from ..operators import quota as Q
from ..operators.register import ADDRESS_COLUMNS
from ..sources import files as FS
from ..sources.fixtures import cte, derived
from ..streaming import pipelines as P
from ..streaming import stateful as ST
from ..streaming import watches as W
from . import common as C
from .alerts import BURST_ERRORS, O_BURST, SLOW_MS, security_hits, slow_windows, tiered_alerts, tiered_sql
from .logs import parse_log_lines
from .registry import ORACLES, query
from .sources import stage_logs
from .store import fresh, register_table, spatial_layout

QUOTA_WINDOW_S = 15 * 60
QUOTA_LIMIT = 1000
LAST_LINE = "9999-12-31 end of log"


@query("stream_logs", ORACLES["route_alert_logs"])
def stream_logs(spark, sf):
    """ST1 + S21: log files streamed (availableNow) through parsing into daily log and alert sinks."""
    out = P.run_dir(spark, "logs")
    src = stage_logs(spark, sf, f"{out}/src")
    P.ingest_logs(spark, src, out, parse_log_lines).awaitTermination()
    # one more line in each log ends its last event; it is no event itself
    logs = spark.read.text(src).select("file").distinct()
    end = logs.select("file", F.lit(LAST_LINE).alias("value")).repartition("file")
    end.write.mode("append").partitionBy("file").text(src)
    P.ingest_logs(spark, src, out, parse_log_lines).awaitTermination()
    logs = spark.read.parquet(f"{out}/logs").where("day IS NOT NULL")
    alerts = spark.read.parquet(f"{out}/alerts").groupBy("day").agg(F.count(F.lit(1)).alias("alert_events"))
    per_day = logs.groupBy("day").agg(F.count(F.lit(1)).alias("log_events"))
    return per_day.join(alerts, "day", "left").select(F.col("day").cast("date").alias("day"), "log_events",
                                                      F.coalesce("alert_events", F.lit(0)).alias("alert_events"))


# ------------------------------------------------------------------ ST12
def service_alerts(spark, sf):
    """Threshold alerts of each service: requests to the health, admin and other routes are services of their own."""
    r = derived(spark, sf, "burst_log").withColumn("service", L.endpoint_type(F.col("path")))
    return tiered_alerts(r, ["service"]).select("alert_type", "service", "severity", "window_start")


_RANK = "CASE severity WHEN 'info' THEN 1 WHEN 'warning' THEN 2 WHEN 'error' THEN 3 WHEN 'critical' THEN 4 ELSE 0 END"
_REPEAT = "CASE e.rank WHEN 1 THEN 43200 WHEN 2 THEN 1800 WHEN 4 THEN 300 ELSE 3600 END"
_SERVICE = "CASE WHEN starts_with(path, '/api/v1/health') THEN 'health' WHEN starts_with(path, '/api/v1/admin') THEN 'admin' ELSE 'api' END"
# the alert rows per service, then each episode's notifications one after another
O_EPISODES = O_BURST.replace("WITH ", "WITH RECURSIVE ", 1) + tiered_sql(_SERVICE)
O_EPISODES += f""",
g AS (SELECT alert_type, service, ws, max({_RANK}) AS rank FROM a WHERE severity IS NOT NULL GROUP BY 1, 2, 3),
o AS (SELECT *, CASE WHEN lag(ws) OVER k IS NULL OR epoch(ws) - epoch(lag(ws) OVER k) > 300 THEN 1 ELSE 0 END AS opens
      FROM g WINDOW k AS (PARTITION BY alert_type, service ORDER BY ws)),
e AS (SELECT *, sum(opens) OVER (PARTITION BY alert_type, service ORDER BY ws) AS episode FROM o),
sent AS (
  SELECT alert_type, service, episode, ws, rank FROM e WHERE opens = 1
  UNION ALL
  SELECT s.alert_type, s.service, s.episode, min(e.ws), arg_min(e.rank, e.ws)
  FROM sent s JOIN e ON e.alert_type = s.alert_type AND e.service = s.service AND e.episode = s.episode AND e.ws > s.ws
       AND (e.rank > s.rank OR epoch(e.ws) - epoch(s.ws) >= {_REPEAT})
  GROUP BY s.alert_type, s.service, s.episode, s.ws)
"""
_EPISODE_ROWS = """SELECT e.alert_type, e.service, CASE e.rank WHEN 1 THEN 'info' WHEN 2 THEN 'warning' WHEN 3 THEN 'error' WHEN 4 THEN 'critical' END
       AS severity, strftime(e.ws, '%Y-%m-%d %H:%M:%S.%f') AS window_start, s.ws IS NOT NULL AS notified, CAST(e.episode AS BIGINT) AS episode
FROM e LEFT JOIN sent s ON s.alert_type = e.alert_type AND s.service = e.service AND s.ws = e.ws"""


@query("alert_dedup", O_EPISODES + _EPISODE_ROWS)
def alert_dedup(spark, sf):
    """ST12: alerts grouped by alert and service into episodes; which windows are notified."""
    return EP.notifications(service_alerts(spark, sf))


@query("alert_episodes", O_EPISODES + """, r AS (""" + _EPISODE_ROWS.replace("strftime(e.ws, '%Y-%m-%d %H:%M:%S.%f') AS window_start", "e.ws, e.rank") + """)
SELECT alert_type, service, episode, strftime(min(ws), '%Y-%m-%d %H:%M:%S.%f') AS started, strftime(max(ws), '%Y-%m-%d %H:%M:%S.%f') AS last_window,
       strftime(max(ws) + INTERVAL 300 SECOND, '%Y-%m-%d %H:%M:%S.%f') AS resolved, count(*) AS windows,
       count(*) FILTER (WHERE notified) AS notifications, arg_max(severity, rank) AS severity FROM r GROUP BY 1, 2, 3""")
def alert_episodes(spark, sf):
    """ST12: each episode from its first window to its resolution, with its notifications and highest severity."""
    return EP.episodes(EP.notifications(service_alerts(spark, sf)))


@query("stream_alerts", O_EPISODES + _EPISODE_ROWS)
def stream_alerts(spark, sf):
    """ST12 on a stream with keyed state and timers: the notified windows of the batch report."""
    a = service_alerts(spark, sf).withColumn("window_start", F.col("window_start").cast("timestamp"))
    got = streamed(spark, a, "window_start", a, ST.alert_episodes, "window_start", "alerts")
    return got.where("NOT resolved").select("alert_type", "service", "severity", "window_start", "notified", "episode")


# ------------------------------------------------------------------ ST13
O_QUOTA = cte("request_log") + f""", r AS (SELECT client, request_id, epoch_us(ts) AS t FROM request_log WHERE client IS NOT NULL)
"""
_QUOTA_STARTS = f""", w AS (
  SELECT client, min(t) AS s FROM r GROUP BY client
  UNION ALL SELECT w.client, min(r.t) FROM w JOIN r ON r.client = w.client AND r.t > w.s + {QUOTA_WINDOW_S * 1_000_000} GROUP BY w.client, w.s)
, q AS (SELECT r.*, w.s, row_number() OVER (PARTITION BY r.client, w.s ORDER BY r.t, r.request_id) AS rank
        FROM r ASOF JOIN w ON w.client = r.client AND w.s <= r.t)
"""
O_QUOTA = O_QUOTA.replace("WITH ", "WITH RECURSIVE ", 1) + _QUOTA_STARTS


@query("quota_breaches", O_QUOTA + f"""SELECT client, count(DISTINCT s) AS windows, count(*) AS requests,
  count(*) FILTER (WHERE rank <= {QUOTA_LIMIT}) AS allowed, count(*) FILTER (WHERE rank > {QUOTA_LIMIT}) AS rejected FROM q GROUP BY client""")
def quota_breaches(spark, sf):
    """ST13: fixed 15-minute windows from each client's first request, 1000 allowed per window."""
    r = derived(spark, sf, "request_log").select(F.col("client"), "request_id", M.micros("ts").alias("ts_us"))
    w = Q.fixed_windows(r, "client", "ts_us", QUOTA_WINDOW_S * 1_000_000, QUOTA_LIMIT)
    return w.groupBy("client").agg(
        F.countDistinct("window_start_us").alias("windows"), F.count(F.lit(1)).alias("requests"),
        F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("rejected"))


STREAM_LIMIT = 2  # the log holds few requests a client and window


@query("stream_quota", O_QUOTA + f"""SELECT CAST(client AS VARCHAR) AS client, request_id, strftime(make_timestamp(t), '%Y-%m-%d %H:%M:%S.%f') AS ts,
  strftime(make_timestamp(s), '%Y-%m-%d %H:%M:%S.%f') AS window_start, rank AS rank_in_window, rank <= {STREAM_LIMIT} AS allowed FROM q""")
def stream_quota(spark, sf):
    """ST13 on a stream: keyed state per client from its first request, evicted by a timer."""
    r = derived(spark, sf, "request_log").select("client", "request_id", F.col("ts").cast("timestamp").alias("ts"))
    return streamed(spark, r, "ts", r, lambda s: ST.quota(s, QUOTA_WINDOW_S * 1_000_000, STREAM_LIMIT), "ts", "quota")


# ------------------------------------------------------------------ ST2-ST5 on streams
def _log_stream(spark, sf, *cols):
    return derived(spark, sf, "burst_log").select(F.col("ts").cast("timestamp").alias("ts"), *cols)


@query("stream_error_burst", ORACLES["error_burst"])
def stream_error_burst(spark, sf):
    """ST2 on a stream: 5-minute windows every minute with more than 5 errors, top error names by sketch."""
    r = _log_stream(spark, sf, "status_code", "error_name")
    return streamed(spark, r, "ts", r.where("status_code >= 400"), lambda s: W.error_burst_watch(s, BURST_ERRORS), "window_start", "errors")


@query("stream_slow_queries", ORACLES["slow_query_pattern"])
def stream_slow_queries(spark, sf):
    """ST3 on a stream: 10-minute windows every 2 minutes with more than 3 slow calls."""
    r = _log_stream(spark, sf, "duration_ms")
    return streamed(spark, r, "ts", r.where(F.col("duration_ms") >= SLOW_MS), lambda s: W.slow_call_watch(s, slow_windows), "window_start", "slow")


@query("stream_security", ORACLES["security_events"])
def stream_security(spark, sf):
    """ST5 on a stream: 2-minute windows every 30 s, top events and addresses by sketch."""
    r = _log_stream(spark, sf, "request_id", "ip", "path", "query_text", "body_text", "forwarded_for")
    hit = r.where(F.col("forwarded_for").contains(".."))
    return streamed(spark, r, "ts", hit, lambda s: W.security_watch(security_hits(s)), "window_start", "security")


@query("stream_traffic", f"SELECT * EXCLUDE (distinct_ips) FROM ({ORACLES['traffic_anomaly']})")
def stream_traffic(spark, sf):
    """ST4 on a stream: every 5-minute bucket, empty ones too, with top endpoints, spike and drop."""
    r = _log_stream(spark, sf, "status_code", "ip", L.route_pattern(F.col("path")).alias("route"))
    return streamed(spark, r, "ts", r, ST.traffic_watch, "bucket", "traffic").drop("distinct_ips")


SLICES = 3


def streamed(spark, rows, ts: str, last, watch, out_ts: str, name: str):
    """The rows run through a stream in SLICES parts in time order, and what the stream put out.

    All tasks write: the rows once, then each part, which a run from the same checkpoint takes as one batch. A row of
    ``last`` two days after all others, in a run of its own, lets the watermark pass everything; what comes of it is left out.
    """
    ST.use_rocksdb(spark)
    out = P.run_dir(spark, name)
    rows.write.parquet(f"{out}/rows")
    kept = spark.read.schema(rows.schema).parquet(f"{out}/rows")
    rows, last = kept, kept if last is rows else last
    end = rows.agg(F.max(ts)).first()[0]
    if end is None:
        return _nothing(spark, rows, watch)
    cuts = rows.select(F.percentile_approx(F.unix_micros(ts), [i / SLICES for i in range(1, SLICES)])).first()[0]
    part = sum((F.when(F.unix_micros(ts) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    later = F.lit(end).cast("timestamp") + F.expr("INTERVAL 2 DAYS")
    beyond = last.limit(1).withColumn(ts, later).select(rows.columns)
    for more in (*[rows.where(part == i) for i in range(SLICES)], beyond):
        more.write.mode("append").parquet(f"{out}/src")
        source = spark.readStream.schema(rows.schema).parquet(f"{out}/src")
        W.into_files(watch(source), out).awaitTermination()
    got = spark.read.parquet(f"{out}/data").where(F.col(out_ts) <= F.lit(end).cast("timestamp"))
    return got.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in got.dtypes])


def _nothing(spark, rows, watch):
    """The empty result with the stream's columns."""
    source = spark.readStream.schema(rows.schema).parquet(P.run_dir(spark, "empty"))
    return spark.createDataFrame([], watch(source).schema)


@query("stream_register", C.O_REGISTER + "SELECT * FROM addresses")
def stream_register(spark, sf):
    """ST15: new address files streamed through the load and upserted into the stored register."""
    root = FS.stage_dataset(spark, sf)
    src = f"{root}/G-NAF/G-NAF DEMO/Standard/address_detail"
    cols = derived(spark, sf, "address_detail").columns
    schema = ", ".join(f"{c} string" for c in cols) + ", file_name string"
    table = register_table(spark, fresh(spark, "stream-register"), C.addresses(spark, sf))
    P.register_refresh_stream(spark, src, schema, C.geocodes(spark, sf), C.localities(spark, sf), C.streets(spark, sf), table,
                              spatial_layout, P.run_dir(spark, "register"), C.AS_OF_DATE).awaitTermination()
    return table.read().select(*ADDRESS_COLUMNS)
