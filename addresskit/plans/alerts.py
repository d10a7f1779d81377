"""Alerting over request logs, batch twins of the streaming rules (W4-W7, ST2-ST11, ST14, J21).

Time series are built per minute from the request log (one row per minute,
so their size follows the time range, not the data volume). Trailing
windows ("rate over 5 m") are computed by exploding each minute into the
windows it belongs to and summing per window end, which distributes like
any aggregate. "for: d" conditions are gaps-and-islands over the series.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import logs as L
from ..operators import metrics as M
from ..sources.fixtures import cte, derived
from .logs import HIST_BOUNDS, O_LOG, _stats, log
from .registry import ORACLES, query

SUSPICIOUS = L.is_suspicious


# ------------------------------------------------------------------ series
def _per_minute(spark, sf, source="request_log"):
    r = derived(spark, sf, source)
    bounds = [F.count_if(F.col("duration_ms") / 1000.0 <= b).alias(f"le{i}") for i, b in enumerate(HIST_BOUNDS)]
    return r.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status_code") >= 500).alias("err5xx"),
        F.count_if(F.col("status_code") == 403).alias("f403"),
        F.count_if(F.col("status_code") == 429).alias("r429"),
        F.count_if(F.col("cache_hit")).alias("cache_hits"),
        F.count_if(F.col("path").contains("/validate")).alias("validations"),
        F.count_if(F.col("path").contains("/validate") & (F.col("status_code") < 400)).alias("validations_ok"),
        F.sum("duration_ms").alias("duration_sum"),
        *bounds,
    )


_SERIES_COLS = ["total", "err5xx", "f403", "r429", "cache_hits", "validations", "validations_ok", "duration_sum"] + [
    f"le{i}" for i in range(len(HIST_BOUNDS))]


def trailing(df, minutes: int, cols):
    """Sum of ``cols`` over the trailing ``minutes`` (window end = t, start exclusive)."""
    e = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(minutes - 1))))
    e = e.withColumn("t", F.col("minute") + F.make_dt_interval(mins=F.col("_k")))
    return e.groupBy("t").agg(*[F.sum(c).alias(c) for c in cols])


def _p95_from_buckets(q: float = 0.95):
    """histogram_quantile over the bucket columns of one row (linear interpolation)."""
    total = F.col("total")
    rank = F.lit(q) * total
    expr = None
    prev_le, prev_c = F.lit(0.0), F.lit(0)
    for i, b in enumerate(HIST_BOUNDS):
        c = F.col(f"le{i}")
        val = prev_le + (F.lit(b) - prev_le) * (rank - prev_c) / (c - prev_c)
        expr = (F.when if expr is None else expr.when)(c >= rank, val)
        prev_le, prev_c = F.lit(b), c
    return expr.otherwise(F.lit(HIST_BOUNDS[-1]))


def _islands_out(df, rule: str, cond, step_s: int, hold_s: int):
    s = df.select(F.lit(rule).alias("rule"), F.col("t"), cond.alias("cond"))
    return M.islands(s, ["rule"], "t", "cond", step_s, hold_s).select(
        "rule", "start", "last", F.col("buckets").cast("long").alias("buckets"), "fires_at")


# ------------------------------------------------------------------ oracle helpers
_PM = ", pm AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS total, " + ", ".join([
    "count(*) FILTER (WHERE status_code >= 500) AS err5xx",
    "count(*) FILTER (WHERE status_code = 403) AS f403",
    "count(*) FILTER (WHERE status_code = 429) AS r429",
    "count(*) FILTER (WHERE cache_hit) AS cache_hits",
    "count(*) FILTER (WHERE contains(path, '/validate')) AS validations",
    "count(*) FILTER (WHERE contains(path, '/validate') AND status_code < 400) AS validations_ok",
    "sum(duration_ms) AS duration_sum",
] + [f"count(*) FILTER (WHERE CAST(duration_ms AS DOUBLE) / 1000 <= CAST({b!r} AS DOUBLE)) AS le{i}"
     for i, b in enumerate(HIST_BOUNDS)]) + " FROM rl GROUP BY 1)\n"
O_BURST = cte("burst_log") + O_LOG.removeprefix(cte("request_log")).replace("FROM request_log", "FROM burst_log")
_PM_SQL, _PM_BURST_SQL = O_LOG + _PM, O_BURST + _PM


def _trail_sql(name, minutes):
    cols = ", ".join(f"sum({c}) AS {c}" for c in _SERIES_COLS)
    return (f", {name} AS (SELECT minute + k * INTERVAL 1 MINUTE AS t, {cols} "
            f"FROM pm CROSS JOIN range(0, {minutes}) r(k) GROUP BY 1)\n")


def _islands_sql(src, rule, cond, step_s, hold_s):
    return f"""SELECT '{rule}' AS rule, strftime(min(t), '%Y-%m-%d %H:%M:%S.%f') AS start,
       strftime(max(t), '%Y-%m-%d %H:%M:%S.%f') AS last, count(*) AS buckets,
       strftime(min(t) + INTERVAL {hold_s} SECOND, '%Y-%m-%d %H:%M:%S.%f') AS fires_at
FROM (SELECT t, c, sum(g) OVER (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl
      FROM (SELECT t, c, CASE WHEN lag(t) OVER (ORDER BY t) IS NULL
                               OR epoch(t) - epoch(lag(t) OVER (ORDER BY t)) > {step_s}
                               OR lag(c) OVER (ORDER BY t) <> c THEN 1 ELSE 0 END AS g
            FROM (SELECT t, coalesce({cond}, false) AS c FROM {src})))
WHERE c GROUP BY isl HAVING epoch(max(t)) + {step_s} - epoch(min(t)) >= {hold_s}"""


def _p95_sql(q=0.95):
    parts = []
    prev_le, prev_c = "0.0", "0"
    for i, b in enumerate(HIST_BOUNDS):
        parts.append(f"WHEN le{i} >= {q} * total THEN {prev_le} + ({b!r} - {prev_le}) * ({q} * total - {prev_c}) "
                     f"/ (le{i} - {prev_c})")
        prev_le, prev_c = repr(b), f"le{i}"
    return "CASE " + " ".join(parts) + f" ELSE {HIST_BOUNDS[-1]!r} END"


# ------------------------------------------------------------------ ST7-ST9, ST11, ST10
_RULES = {
    # name: (trailing minutes, condition (Spark), condition (SQL), hold seconds)
    "rule_error_rate": (5, lambda: (F.try_divide(F.col("err5xx"), F.col("total")) * 100) > 5,
                        "CAST(err5xx AS DOUBLE) / total * 100 > 5", 120),
    "rule_latency": (5, lambda: _p95_from_buckets() > 1.0, f"({_p95_sql()}) > 1.0", 180),
    "rule_throughput": (5, lambda: (F.col("total") / 300.0) < 10, "CAST(total AS DOUBLE) / 300 < 10", 300),
    "rule_cache": (5, lambda: F.try_divide(F.col("cache_hits"), F.col("total")) < 0.70,
                   "CAST(cache_hits AS DOUBLE) / total < 0.70", 300),
    "rule_validation": (10, lambda: (F.try_divide(F.col("validations_ok"), F.col("validations")) * 100) < 90,
                        "CAST(validations_ok AS DOUBLE) / validations * 100 < 90", 300),
    "rule_forbidden": (5, lambda: (F.col("f403") / 300.0) > 5, "CAST(f403 AS DOUBLE) / 300 > 5", 120),
    "rule_ratelimit": (5, lambda: F.col("r429") > 100, "r429 > 100", 60),
}


_ON_BURSTS = {"rule_forbidden", "rule_ratelimit"}  # the plain log has neither


def _make_rule(name, minutes, cond, cond_sql, hold):
    source, pm_sql = ("burst_log", _PM_BURST_SQL) if name in _ON_BURSTS else ("request_log", _PM_SQL)

    @query(name, pm_sql + _trail_sql("tr", minutes) + _islands_sql("tr", name, cond_sql, 60, hold))
    def q(spark, sf):
        s = trailing(_per_minute(spark, sf, source), minutes, _SERIES_COLS)
        return _islands_out(s, name, F.coalesce(cond(), F.lit(False)), 60, hold)

    q.__doc__ = f"ST7-ST9: '{name}' over a trailing {minutes}-minute window, held for {hold} s."
    return q


for _n, (_m, _c, _cs, _h) in _RULES.items():
    _make_rule(_n, _m, _c, _cs, _h)


@query("rule_gauges", _PM_SQL + """, cal AS (SELECT unnest(generate_series((SELECT min(minute) FROM pm),
  (SELECT max(minute) FROM pm), INTERVAL 1 MINUTE)) AS t),
g AS (SELECT cal.t, coalesce(pm.total, 0) AS total, pm.duration_sum FROM cal LEFT JOIN pm ON pm.minute = cal.t)
""" + _islands_sql("g", "service_down", "total = 0", 60, 60) + "\nUNION ALL\n"
       + _islands_sql("g", "mean_query_time", "CAST(duration_sum AS DOUBLE) / total > 1000", 60, 60))
def rule_gauges(spark, sf):
    """ST11: gauge rules on the minute calendar: no traffic in a minute (down), mean time > 1000 ms."""
    pm = _per_minute(spark, sf)
    rng = pm.agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    cal = rng.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MINUTE"))).alias("t"))
    g = cal.join(pm.withColumnRenamed("minute", "t"), "t", "left").select(
        "t", F.coalesce("total", F.lit(0)).alias("total"), "duration_sum")
    down = _islands_out(g, "service_down", F.col("total") == 0, 60, 60)
    slow = _islands_out(g, "mean_query_time", F.coalesce(F.try_divide(F.col("duration_sum"), F.col("total")) > 1000,
                                                         F.lit(False)), 60, 60)
    return down.unionByName(slow)


@query("traffic_vs_yesterday", _PM_SQL + _trail_sql("tr", 5) + """, y AS (
  SELECT a.t, CAST(a.total AS DOUBLE) / 300 AS rate, CAST(b.total AS DOUBLE) / 300 AS rate_yesterday
  FROM tr a JOIN tr b ON b.t = a.t - INTERVAL 1 DAY)
""" + _islands_sql("y", "traffic_vs_yesterday", "abs(rate - rate_yesterday) / rate_yesterday > 0.5", 60, 600))
def traffic_vs_yesterday(spark, sf):
    """ST10 + J21: 5-minute rate against the same time yesterday (equi self-join on t - 1 day), > 50 % for 10 m."""
    s = trailing(_per_minute(spark, sf), 5, ["total"])
    y = s.select(F.col("t").alias("ty"), F.col("total").alias("total_y"))
    j = s.join(y, F.col("ty") == F.col("t") - F.expr("INTERVAL 1 DAY"))
    rate, rate_y = F.col("total") / 300.0, F.col("total_y") / 300.0
    return _islands_out(j, "traffic_vs_yesterday", F.abs(rate - rate_y) / rate_y > 0.5, 60, 600)


# ------------------------------------------------------------------ W4/ST4, W5, W6, W7
TOP_ENDPOINTS = 10


@query("traffic_anomaly", O_BURST + """, b AS (
  SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, count(*) AS n, count(*) FILTER (WHERE status_code >= 400) AS errors,
         count(DISTINCT ip) AS distinct_ips FROM rl GROUP BY 1),
e AS (SELECT bucket, string_agg(route || ':' || CAST(n AS VARCHAR), '|' ORDER BY rk) AS top_endpoints FROM (
  SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, route, count(*) AS n,
         row_number() OVER (PARTITION BY time_bucket(INTERVAL 5 MINUTE, ts) ORDER BY count(*) DESC, route) AS rk
  FROM rl GROUP BY 1, 2) WHERE rk <= 10 GROUP BY 1),
cal AS (SELECT unnest(generate_series((SELECT min(bucket) FROM b), (SELECT max(bucket) FROM b), INTERVAL 5 MINUTE)) AS bucket),
f AS (SELECT cal.bucket, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors, coalesce(distinct_ips, 0) AS distinct_ips,
             coalesce(top_endpoints, '') AS top_endpoints
      FROM cal LEFT JOIN b ON b.bucket = cal.bucket LEFT JOIN e ON e.bucket = cal.bucket)
SELECT strftime(a.bucket, '%Y-%m-%d %H:%M:%S.%f') AS bucket, a.n, a.errors,
       CASE WHEN a.n > 0 THEN round(CAST(a.errors AS DOUBLE) / a.n, 4) END AS error_share, a.distinct_ips, a.top_endpoints,
       coalesce(p.n, 0) AS prev_n,
       p.n IS NOT NULL AND a.n > 3 * p.n AS spike,
       coalesce(p.n, 0) > 10 AND a.n < 0.3 * coalesce(p.n, 0) AS drop
FROM f a LEFT JOIN f p ON p.bucket = a.bucket - INTERVAL 5 MINUTE""")
def traffic_anomaly(spark, sf):
    """ST4 + W4: 5-minute buckets, error share, distinct IPs, top endpoints; spike / drop against the previous bucket."""
    return anomalies(derived(spark, sf, "burst_log").withColumn("route", L.route_pattern(F.col("path"))))


def anomalies(r):
    """W4 on the bucket calendar: an empty bucket is a row (n = 0), so traffic that stops is a drop and traffic after
    it a spike; the first bucket has no predecessor and is neither. ``r`` holds ``ts, status_code, ip, route``."""
    r = r.withColumn("bucket", F.window("ts", "5 minutes").start)
    b = r.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status_code") >= 400).alias("errors"),
        F.countDistinct("ip").alias("distinct_ips"))
    top = _top_list(r, "bucket", "route", TOP_ENDPOINTS).withColumnRenamed("top_routes", "top_endpoints")
    span = b.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"))
    cal = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 5 MINUTES"))).alias("bucket"))
    b = cal.join(b, "bucket", "left").join(top, "bucket", "left").fillna(0, ["n", "errors", "distinct_ips"]).fillna("", ["top_endpoints"])
    prev = b.select((F.col("bucket") + F.expr("INTERVAL 5 MINUTES")).alias("bucket"), F.col("n").alias("prev_n"))
    j = b.join(prev, "bucket", "left")
    spike = F.col("prev_n").isNotNull() & (F.col("n") > 3 * F.col("prev_n"))
    drop = F.col("prev_n").isNotNull() & (F.col("prev_n") > 10) & (F.col("n") < 0.3 * F.col("prev_n"))
    return j.select("bucket", "n", "errors", F.round(F.try_divide("errors", "n"), 4).alias("error_share"), "distinct_ips",
                    "top_endpoints", F.coalesce("prev_n", F.lit(0)).alias("prev_n"), spike.alias("spike"), drop.alias("drop"))


def _counters(spark, sf):
    return derived(spark, sf, "counters")


@query("counter_rate", cte("counters") + """, d AS (
  SELECT metric, minute, value, lag(value) OVER (PARTITION BY metric ORDER BY minute) AS prev FROM counters),
d2 AS (SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS delta FROM d),
w AS (SELECT metric, minute + k * INTERVAL 1 MINUTE AS t, sum(delta) AS increase
      FROM d2 CROSS JOIN range(0, 5) r(k) GROUP BY 1, 2)
SELECT metric, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS t, CAST(increase AS BIGINT) AS increase_5m,
       round(CAST(increase AS DOUBLE) / 300, 6) AS rate_5m FROM w""")
def counter_rate(spark, sf):
    """Counter increase and per-second rate over 5 minutes, with counter resets."""
    return increases(_counters(spark, sf))


def increases(c):
    """W5 over (metric, minute, value) samples; the sample before is found in the day, else on the last day that has one."""
    w = Window.partitionBy("metric", F.to_date("minute")).orderBy("minute")
    d = c.withColumn("prev", F.lag("value").over(w))
    # a day's first sample follows the last one of the latest earlier day with samples: one row per metric and day
    last = c.groupBy("metric", F.to_date("minute").alias("day")).agg(F.max_by("value", "minute").alias("last_v"))
    last = last.withColumn("last_v", F.lag("last_v").over(Window.partitionBy("metric").orderBy("day")))
    d = d.withColumn("day", F.to_date("minute")).join(last, ["metric", "day"], "left")
    prev = F.coalesce(F.col("prev"), F.col("last_v"))
    delta = F.when(prev.isNull(), 0).when(F.col("value") < prev, F.col("value")).otherwise(F.col("value") - prev)
    d = d.withColumn("delta", delta).withColumnRenamed("metric", "m")
    e = d.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn(
        "t", F.col("minute") + F.make_dt_interval(mins=F.col("_k")))
    g = e.groupBy(F.col("m").alias("metric"), "t").agg(F.sum("delta").alias("increase_5m"))
    return g.select("metric", "t", F.col("increase_5m").cast("long"),
                    F.round(F.col("increase_5m") / 300.0, 6).alias("rate_5m"))


@query("counter_growth", cte("counters") + """SELECT a.metric, strftime(a.minute, '%Y-%m-%d %H:%M:%S.%f') AS minute, a.value,
  CAST(b.value AS DOUBLE) AS value_5m_ago, b.value IS NOT NULL AND a.value > b.value AS grew
FROM counters a LEFT JOIN counters b ON b.metric = a.metric AND b.minute = a.minute - INTERVAL 5 MINUTE""")
def counter_growth(spark, sf):
    """Counter compared with its value 5 minutes earlier (equi self-join on the shifted minute)."""
    c = _counters(spark, sf)
    b = c.select("metric", (F.col("minute") + F.expr("INTERVAL 5 MINUTES")).alias("minute"),
                 F.col("value").alias("value_5m_ago"))
    j = c.join(b, ["metric", "minute"], "left")
    return j.select("metric", "minute", "value", F.col("value_5m_ago").cast("double"),
                    (F.col("value_5m_ago").isNotNull() & (F.col("value") > F.col("value_5m_ago"))).alias("grew"))


@query("sustained_alert", O_LOG + """, h AS (SELECT date_trunc('hour', ts) AS t,
  CAST(count(*) FILTER (WHERE status_code >= 400) AS DOUBLE) / count(*) > 0.2 AS hot FROM rl GROUP BY 1)
""" + _islands_sql("h", "error_share_hourly", "hot", 3600, 7200))
def sustained_alert(spark, sf):
    """Hourly error share above 20 % held for at least two hours (gaps and islands)."""
    r = derived(spark, sf, "request_log")
    h = r.groupBy(F.date_trunc("hour", "ts").alias("t")).agg(
        (F.count_if(F.col("status_code") >= 400) / F.count(F.lit(1)) > 0.2).alias("hot"))
    return _islands_out(h, "error_share_hourly", F.col("hot"), 3600, 7200)


# ------------------------------------------------------------------ ST2, ST3, ST5, ST6, ST14
def _sliding_sql(src_where, size_s, slide_s):
    """Each row in every sliding window (start aligned to the slide) that contains it."""
    n = size_s // slide_s
    return f"""SELECT *, to_timestamp((floor(epoch(ts) / {slide_s}) - k) * {slide_s})::TIMESTAMP AS wstart
FROM rl CROSS JOIN range(0, {n}) r(k) WHERE {src_where}"""


def _top_list(df, key, item, k=10):
    c = df.groupBy(key, item).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(key).orderBy(F.desc("_n"), item)
    c = c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return c.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(":", F.col(item), F.col("_n").cast("string")).alias("s")))),
        lambda x: x["s"]), "|").alias(f"top_{item}s"))


def _top_sql(src, item, k=10):
    return f"""SELECT wstart, string_agg({item} || ':' || CAST(n AS VARCHAR), '|' ORDER BY rk) AS top_{item}s FROM (
  SELECT wstart, {item}, count(*) AS n, row_number() OVER (PARTITION BY wstart ORDER BY count(*) DESC, {item}) AS rk
  FROM {src} GROUP BY 1, 2) WHERE rk <= {k} GROUP BY 1"""


@query("error_burst", O_BURST + f""", s AS ({_sliding_sql('status_code >= 400', 300, 60)}),
c AS (SELECT wstart, count(*) AS n_errors FROM s GROUP BY 1 HAVING count(*) > 5),
t AS ({_top_sql('s WHERE error_name IS NOT NULL', 'error_name')})
SELECT strftime(c.wstart, '%Y-%m-%d %H:%M:%S.%f') AS window_start, c.n_errors, coalesce(t.top_error_names, '') AS top_error_names
FROM c LEFT JOIN t ON t.wstart = c.wstart""")
def error_burst(spark, sf):
    """ST2: every minute over the last 5: more than 5 errors, with the top 10 error names."""
    r = derived(spark, sf, "burst_log").filter(F.col("status_code") >= 400)
    s = r.withColumn("wstart", F.window("ts", "5 minutes", "1 minute").start)
    c = s.groupBy("wstart").agg(F.count(F.lit(1)).alias("n_errors")).filter(F.col("n_errors") > BURST_ERRORS)
    t = _top_list(s.where("error_name IS NOT NULL"), "wstart", "error_name")
    return c.join(t, "wstart", "left").select(F.col("wstart").alias("window_start"), "n_errors",
                                              F.coalesce("top_error_names", F.lit("")).alias("top_error_names"))


@query("slow_query_pattern", O_BURST + f""", s AS ({_sliding_sql('duration_ms >= 1000', 600, 120)})
SELECT strftime(wstart, '%Y-%m-%d %H:%M:%S.%f') AS window_start, count(*) AS n_slow, round(avg(duration_ms), 4) AS avg_ms,
       max(duration_ms) AS max_ms FROM s GROUP BY wstart HAVING count(*) > 3""")
def slow_query_pattern(spark, sf):
    """ST3: every 2 minutes over the last 10: more than 3 requests of >= 1000 ms; mean and max."""
    return slow_windows(derived(spark, sf, "burst_log"))


# An error burst has more than 5 errors; a slow-query pattern more than 3 calls of 1000 ms.
BURST_ERRORS = 5
SLOW_CALLS, SLOW_MS = 3, 1000


def slow_windows(r):
    """ST3 on a table or a stream of ``ts, duration_ms``."""
    s = r.filter(F.col("duration_ms") >= SLOW_MS).groupBy(F.window("ts", "10 minutes", "2 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("n_slow"), F.round(F.avg("duration_ms"), 4).alias("avg_ms"), F.max("duration_ms").alias("max_ms"))
    return s.filter(F.col("n_slow") > SLOW_CALLS).select(F.col("w.start").alias("window_start"), "n_slow", "avg_ms", "max_ms")


# Names of the security events.
SECURITY_EVENTS = ["suspicious_query_params", "suspicious_request_body", "suspicious_header"]


def security_hits(r):
    """a row per security event of a request (suspicious query, suspicious body, ``..`` in the proxy header)."""
    found = [SUSPICIOUS(F.col("query_text")), SUSPICIOUS(F.col("body_text")), F.col("forwarded_for").contains("..")]
    events = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in zip(found, SECURITY_EVENTS)]), lambda x: x.isNotNull())
    return r.select("request_id", "ts", "ip", "path", F.explode(events).alias("event"))


def _susp_sql(col):
    return "(" + " OR ".join(f"regexp_matches({col}, '{p}', 'i')" for p in L.SUSPICIOUS_PATTERNS) + ")"


O_HITS = O_BURST + f""", hits AS (
  SELECT request_id, ts, ip, path, '{SECURITY_EVENTS[0]}' AS event FROM rl WHERE {_susp_sql('query_text')}
  UNION ALL SELECT request_id, ts, ip, path, '{SECURITY_EVENTS[1]}' FROM rl WHERE {_susp_sql('body_text')}
  UNION ALL SELECT request_id, ts, ip, path, '{SECURITY_EVENTS[2]}' FROM rl WHERE contains(forwarded_for, '..'))
"""


@query("security_hits", O_HITS + """SELECT request_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, ip, path, event FROM hits""")
def security_hits_query(spark, sf):
    """security events by query, body and proxy header."""
    return security_hits(derived(spark, sf, "burst_log"))


@query("security_events", O_HITS + f""", s AS ({_sliding_sql('true', 120, 30).replace("FROM rl", "FROM hits")}),
c AS (SELECT wstart, count(*) AS n_events FROM s GROUP BY 1),
t AS ({_top_sql('s', 'ip')}),
v AS ({_top_sql('s', 'event')})
SELECT strftime(c.wstart, '%Y-%m-%d %H:%M:%S.%f') AS window_start, c.n_events, v.top_events, t.top_ips
FROM c JOIN t ON t.wstart = c.wstart JOIN v ON v.wstart = c.wstart""")
def security_events(spark, sf):
    """ST5: every 30 s over the last 2 minutes: any security event, with the top events and source IPs."""
    s = security_hits(derived(spark, sf, "burst_log")).withColumn("wstart", F.window("ts", "2 minutes", "30 seconds").start)
    c = s.groupBy("wstart").agg(F.count(F.lit(1)).alias("n_events"))
    t = c.join(_top_list(s, "wstart", "event"), "wstart").join(_top_list(s, "wstart", "ip"), "wstart")
    return t.select(F.col("wstart").alias("window_start"), "n_events", "top_events", "top_ips")


@query("rule_security", O_HITS + """, pm AS (SELECT date_trunc('minute', ts) AS minute, count(*) AS hits FROM hits GROUP BY 1),
tr AS (SELECT minute + k * INTERVAL 1 MINUTE AS t, sum(hits) AS hits FROM pm CROSS JOIN range(0, 5) r(k) GROUP BY 1)
""" + _islands_sql("tr", "rule_security", "hits > 0", 60, 0))
def rule_security(spark, sf):
    """ST9: security events increased over the last 5 minutes (fires at once)."""
    h = security_hits(derived(spark, sf, "burst_log"))
    pm = h.groupBy(F.date_trunc("minute", "ts").alias("minute")).agg(F.count(F.lit(1)).alias("hits"))
    return _islands_out(trailing(pm, 5, ["hits"]), "rule_security", F.col("hits") > 0, 60, 0)


# Performance alert thresholds (ms, %, requests/s, ratio).
RESPONSE_TIME = [("critical", 3000), ("error", 1000), ("warning", 500)]
ERROR_RATE = [("critical", 20), ("error", 10), ("warning", 5)]
THROUGHPUT_MIN = 10
CACHE_MIN = 0.7


def _tiered(value, tiers):
    sev = None
    thr = None
    for name, t in tiers:
        sev = (F.when if sev is None else sev.when)(value > t, F.lit(name))
        thr = (F.when if thr is None else thr.when)(value > t, F.lit(float(t)))
    return sev, thr


def tiered_sql(service: str | None = None) -> str:
    """CTEs ``w``, ``s`` and ``a`` (ST6 rows over ``rl``), per window or per window and ``service`` expression."""
    by = "" if service is None else ", service"
    bucket = "time_bucket(INTERVAL 5 MINUTE, ts)"
    part = bucket if service is None else f"{bucket}, {service}"
    return f""", w AS (SELECT {bucket} AS ws{"" if service is None else f", {service} AS service"}, duration_ms, status_code,
  cache_hit, row_number() OVER (PARTITION BY {part} ORDER BY duration_ms) AS rn, count(*) OVER (PARTITION BY {part}) AS n FROM rl),
s AS (SELECT ws{by}, max(duration_ms) FILTER (WHERE rn = floor(n * 0.95) + 1) AS p95,
  floor(CAST(count(*) FILTER (WHERE status_code >= 400) AS DOUBLE) / count(*) * 10000 + 0.5) / 100 AS err,
  floor(CAST(count(*) AS DOUBLE) / 300 * 100 + 0.5) / 100 AS thr,
  CAST(count(*) FILTER (WHERE cache_hit) AS DOUBLE) / count(*) AS cache FROM w GROUP BY ws{by}),
a AS (
  SELECT ws{by}, 'response_time' AS alert_type,
         CASE WHEN p95 > 3000 THEN 'critical' WHEN p95 > 1000 THEN 'error' WHEN p95 > 500 THEN 'warning' END AS severity,
         CASE WHEN p95 > 3000 THEN 3000 WHEN p95 > 1000 THEN 1000 WHEN p95 > 500 THEN 500 END AS threshold,
         CAST(p95 AS DOUBLE) AS value FROM s
  UNION ALL
  SELECT ws{by}, 'error_rate', CASE WHEN err > 20 THEN 'critical' WHEN err > 10 THEN 'error' WHEN err > 5 THEN 'warning' END,
         CASE WHEN err > 20 THEN 20 WHEN err > 10 THEN 10 WHEN err > 5 THEN 5 END, err FROM s
  UNION ALL
  SELECT ws{by}, 'throughput', CASE WHEN thr < 10 THEN 'warning' END, 10, thr FROM s
  UNION ALL
  SELECT ws{by}, 'cache', CASE WHEN cache < 0.7 THEN 'warning' END, 0.7, round(cache, 4) FROM s)
"""


@query("threshold_alerts", O_LOG + tiered_sql() + """SELECT strftime(ws, '%Y-%m-%d %H:%M:%S.%f') AS window_start, alert_type,
       severity, CAST(threshold AS DOUBLE) AS threshold, value FROM a WHERE severity IS NOT NULL""")
def threshold_alerts(spark, sf):
    """ST6: per 5-minute window, tiered alerts on p95, error %, throughput and cache-hit ratio."""
    return tiered_alerts(derived(spark, sf, "request_log"))


def tiered_alerts(r, by=()):
    """ST6 rows per 5-minute window and the columns ``by``."""
    r = r.withColumn("ws", F.window("ts", "5 minutes").start)
    keys = ["ws", *by]
    s = _stats(r, keys, 300).withColumn("cache", F.col("cache_hit_ratio") / 100)
    cache = r.groupBy(*keys).agg((F.count_if(F.col("cache_hit")) / F.count(F.lit(1))).alias("cache_exact"))
    s = s.join(cache, keys)
    rt_sev, rt_thr = _tiered(F.col("p95_ms"), RESPONSE_TIME)
    er_sev, er_thr = _tiered(F.col("error_rate"), ERROR_RATE)
    alerts = F.array(
        F.struct(F.lit("response_time").alias("alert_type"), rt_sev.alias("severity"), rt_thr.alias("threshold"),
                 F.col("p95_ms").cast("double").alias("value")),
        F.struct(F.lit("error_rate").alias("alert_type"), er_sev.alias("severity"), er_thr.alias("threshold"),
                 F.col("error_rate").cast("double").alias("value")),
        F.struct(F.lit("throughput").alias("alert_type"),
                 F.when(F.col("throughput") < THROUGHPUT_MIN, F.lit("warning")).alias("severity"),
                 F.lit(float(THROUGHPUT_MIN)).alias("threshold"), F.col("throughput").cast("double").alias("value")),
        F.struct(F.lit("cache").alias("alert_type"),
                 F.when(F.col("cache_exact") < CACHE_MIN, F.lit("warning")).alias("severity"),
                 F.lit(CACHE_MIN).alias("threshold"), F.round("cache_exact", 4).alias("value")),
    )
    e = s.select(F.col("ws").alias("window_start"), *by, F.explode(alerts).alias("a")).select("window_start", *by, "a.*")
    return e.filter(F.col("severity").isNotNull())


@query("load_level", O_LOG + """, w AS (SELECT time_bucket(INTERVAL 10 SECOND, ts) AS ws, count(*) AS n,
  CAST(count(*) FILTER (WHERE status_code >= 400) AS DOUBLE) / count(*) * 100 AS error_pct,
  avg(duration_ms) AS mean_ms FROM rl GROUP BY 1)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S.%f') AS window_start, n, round(error_pct, 4) AS error_pct, round(mean_ms, 4) AS mean_ms,
  CASE WHEN error_pct >= 20 OR mean_ms >= 5000 THEN 'emergency' WHEN error_pct >= 10 OR mean_ms >= 2000 THEN 'minimal'
       WHEN error_pct >= 5 OR mean_ms >= 1000 THEN 'reduced' ELSE 'normal' END AS level
FROM w""")
def load_level(spark, sf):
    """ST14 + X31: degradation level per 10-second window (CPU and memory gauges absent -> 0)."""
    r = derived(spark, sf, "request_log")
    w = r.groupBy(F.window("ts", "10 seconds").start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_if(F.col("status_code") >= 400) / F.count(F.lit(1)) * 100).alias("error_pct"),
        F.avg("duration_ms").alias("mean_ms"))
    return w.select("window_start", "n", F.round("error_pct", 4).alias("error_pct"),
                    F.round("mean_ms", 4).alias("mean_ms"),
                    L.load_level(F.col("error_pct"), F.col("mean_ms"), F.lit(None), F.lit(None)).alias("level"))
