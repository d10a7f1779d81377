"""Request-log analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logs as L
from ..operators import metrics as M
from ..operators import quota as Q
from ..sources.fixtures import cte, derived
from .registry import ORACLES, query

AS_OF = "2024-01-15 00:00:00"
RETENTION_AS_OF = "2024-01-30"
RETENTION_DAYS = 7
HIST_BOUNDS = [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0]
BENCH_TARGET_MS = 500
REPEAT_TTL_S = 300


def log(spark, sf):
    r = derived(spark, sf, "request_log")
    return r.withColumn("route", L.route_pattern(F.col("path")))


# ------------------------------------------------------------ oracle helpers
def _in(vals):
    return ", ".join(f"'{v}'" for v in vals)


_ROUTE_SQL = f"""CASE
  WHEN starts_with(path, '/api/v1/health') THEN CASE WHEN path IN ({_in(L.HEALTH_ROUTES)}) THEN path ELSE '/api/v1/health/*' END
  WHEN starts_with(path, '/api/v1/addresses') THEN CASE WHEN path IN ({_in(L.ADDRESS_ROUTES)}) THEN path
       WHEN regexp_matches(path, '{L.PID_ROUTE_PATTERN}') THEN '/api/v1/addresses/:gnaf_pid' ELSE '/api/v1/addresses/*' END
  WHEN starts_with(path, '/api/v1/spatial') THEN CASE WHEN path IN ({_in(L.SPATIAL_ROUTES)}) THEN path ELSE '/api/v1/spatial/*' END
  WHEN starts_with(path, '/api/v1/admin') THEN CASE WHEN path IN ({_in(L.ADMIN_ROUTES)}) THEN path ELSE '/api/v1/admin/*' END
  WHEN starts_with(path, '/api/docs') THEN '/api/docs' ELSE path END"""

O_LOG = cte("request_log") + f""",
rl AS (SELECT *, {_ROUTE_SQL} AS route, epoch_us(ts) AS ts_us FROM request_log)
"""


def _r2(x):
    """JavaScript Math.round(x * 100) / 100 in SQL."""
    return f"floor(({x}) * 100 + 0.5) / 100"


def _pct_sql(x):
    """Math.round(ratio * 10000) / 100."""
    return f"floor(({x}) * 10000 + 0.5) / 100"


def _r2c(c):
    return F.floor(c * 100 + 0.5) / 100


def _pct(c):
    return F.floor(c * 10000 + 0.5) / 100


# ------------------------------------------------------------ X22-X24, F14, F15
@query("route_pattern", O_LOG + """SELECT path, route,
  CASE WHEN starts_with(path, '/api/v1/health') THEN 'health' WHEN starts_with(path, '/api/v1/admin') THEN 'admin'
       ELSE 'api' END AS endpoint_type, count(*) AS n
FROM rl GROUP BY path, route""")
def route_pattern(spark, sf):
    """X22 + X23: route label and endpoint type of every distinct request path."""
    p = derived(spark, sf, "request_log").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return p.select("path", L.route_pattern(F.col("path")).alias("route"),
                    L.endpoint_type(F.col("path")).alias("endpoint_type"), "n")


@query("request_flags", O_LOG + """SELECT request_id, duration_ms > 1000 AS is_slow,
  response_bytes > 1048576 AS is_large, status_code >= 400 AS is_error FROM rl""")
def request_flags(spark, sf):
    """slow / large / error flags per request."""
    r = derived(spark, sf, "request_log")
    return r.select("request_id", *L.request_flags(F.col("duration_ms"), F.col("response_bytes"),
                                                  F.col("status_code")))


def _prio_sql():
    hi = " OR ".join(f"regexp_matches(path, '{p.replace('*', '.*')}')" for p in L.PRIORITY_HIGH)
    md = " OR ".join(f"regexp_matches(path, '{p.replace('*', '.*')}')" for p in L.PRIORITY_MEDIUM)
    return f"CASE WHEN {hi} THEN 'high' WHEN {md} THEN 'medium' ELSE 'low' END"


@query("request_priority", O_LOG + f"SELECT path, {_prio_sql()} AS priority, count(*) AS n FROM rl GROUP BY path")
def request_priority(spark, sf):
    """High / medium / low priority class of every distinct path."""
    p = derived(spark, sf, "request_log").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return p.select("path", L.request_priority(F.col("path")).alias("priority"), "n")


_SUSP_SQL = " OR ".join(f"regexp_matches(query_text, '{p}', 'i')" for p in L.SUSPICIOUS_PATTERNS)


@query("suspicious_requests", O_LOG + f"SELECT request_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, ip, query_text "
       f"FROM rl WHERE {_SUSP_SQL}")
def suspicious_requests(spark, sf):
    """requests whose query text matches a suspicious pattern (security events)."""
    r = derived(spark, sf, "request_log")
    return r.filter(L.is_suspicious(F.col("query_text"))).select("request_id", "ts", "ip", "query_text")


# ------------------------------------------------------------ X28-X30, X32
@query("mask_query", O_LOG + """SELECT request_id, substr(regexp_replace(regexp_replace(regexp_replace(query_text,
  '''[^''"]*''', '''***''', 'g'), '"[^''"]*"', '"***"', 'g'), '\\b\\d{4,}\\b', '***', 'g'), 1, 500) AS masked FROM rl""")
def mask_query(spark, sf):
    """Quoted strings and long numbers masked, 500 characters."""
    r = derived(spark, sf, "request_log")
    return r.select("request_id", L.mask_query(F.col("query_text")).alias("masked"))


_KEY_SQL = ("'cache:user:' || CAST(client AS VARCHAR) || ':session:' || lower(hex(request_id)) || ':email:user' "
            "|| CAST(client AS VARCHAR) || '@example.com:' || path")


@query("mask_key", O_LOG + f"""SELECT request_id, substr(regexp_replace(regexp_replace(regexp_replace({_KEY_SQL},
  'user:\\d+', 'user:***', 'g'), 'session:[a-f0-9-]+', 'session:***', 'g'), 'email:[^:]+', 'email:***', 'g'), 1, 200)
  AS masked FROM rl""")
def mask_key(spark, sf):
    """Cache keys with user, session and email parts masked, 200 characters."""
    r = derived(spark, sf, "request_log")
    key = F.concat(F.lit("cache:user:"), F.col("client").cast("string"), F.lit(":session:"),
                   F.lower(F.hex("request_id")), F.lit(":email:user"), F.col("client").cast("string"),
                   F.lit("@example.com:"), F.col("path"))
    return r.select("request_id", L.mask_key(key).alias("masked"))


# the expected text is written out by hand, value by value
_REDACTED_SQL = ("'{\"address\":\"' || path || '\",\"token\":\"***REDACTED***\",\"auth\":\"***REDACTED***\",'"
                 " || '\"options\":{\"password\":\"***REDACTED***\",\"limit\":10},\"key\":\"***REDACTED***\"}'")


@query("redact_json", O_LOG + f"SELECT request_id, {_REDACTED_SQL} AS body FROM rl")
def redact_json(spark, sf):
    """Sensitive keys at any depth replaced by the marker in the request body JSON."""
    r = derived(spark, sf, "request_log")
    body = F.concat(F.lit('{"address":"'), F.col("path"), F.lit('","token":"t'), F.col("request_id").cast("string"),
                    F.lit('","auth":{"user":{"id":{"pin":"u'), F.col("client").cast("string"),
                    F.lit('"}},"scopes":[[1],{"x":"}"}]},"options":{"password":"p'), F.col("client").cast("string"),
                    F.lit('","limit":10},"key":'), F.col("duration_ms").cast("string"), F.lit("}"))
    return r.select("request_id", L.redact_json(body).alias("body"))


@query("repeat_requests", O_LOG + f""",
c AS (SELECT request_id, ts_us, method || ' ' || path || '?' || query_text AS k,
             (method = 'GET' AND status_code >= 200 AND status_code < 300) OR (method = 'POST' AND status_code = 200
              AND (contains(path, '/search') OR contains(path, '/validate') OR contains(path, '/geocode')
                   OR contains(path, '/spatial'))) AS cacheable
      FROM rl),
p AS (SELECT *, lag(ts_us) OVER (PARTITION BY k, cacheable ORDER BY ts_us, request_id) AS prev_us FROM c)
SELECT request_id, cacheable,
       cacheable AND prev_us IS NOT NULL AND ts_us - prev_us <= {REPEAT_TTL_S} * 1000000 AS repeat_hit
FROM p""")
def repeat_requests(spark, sf):
    """X32 re-aimed: cacheable requests repeating the same key within the 300 s TTL.

    The previous occurrence is found inside (key, hour) partitions by ``lag``;
    the first row of an hour looks back at the key's last row of the previous
    hour through an equi-join on (key, hour - 1), so a busy key is split by hour.
    """
    r = derived(spark, sf, "request_log")
    c = r.select("request_id", "ts", M.micros("ts").alias("ts_us"),
                 F.concat_ws("", "method", F.lit(" "), "path", F.lit("?"), "query_text").alias("k"),
                 L.cacheable(F.col("method"), F.col("status_code"), F.col("path")).alias("cacheable"))
    c = c.withColumn("hour", F.date_trunc("hour", "ts"))
    from pyspark.sql import Window

    w = Window.partitionBy("k", "cacheable", "hour").orderBy("ts_us", "request_id")
    c = c.withColumn("prev_us", F.lag("ts_us").over(w))
    last = c.groupBy("k", "cacheable", "hour").agg(F.max("ts_us").alias("last_us")).withColumn(
        "hour", F.col("hour") + F.expr("INTERVAL 1 HOUR"))
    j = c.join(last, ["k", "cacheable", "hour"], "left")
    prev = F.coalesce(F.col("prev_us"), F.col("last_us"))
    return j.select("request_id", "cacheable",
                    (F.col("cacheable") & prev.isNotNull() & (F.col("ts_us") - prev <= REPEAT_TTL_S * 1000000))
                    .alias("repeat_hit"))


@query("business_counters", O_LOG + """, b AS (
  SELECT CASE WHEN contains(path, '/validate') THEN 'address_validation'
              WHEN contains(path, '/geocode') THEN 'geocoding' WHEN contains(path, '/search') THEN 'address_search' END
           AS metric, path, status_code < 400 AS ok FROM rl)
SELECT metric || CASE WHEN ok THEN '_success' ELSE '_failure' END AS metric, path AS endpoint, count(*) AS n
FROM b WHERE metric IS NOT NULL GROUP BY 1, 2""")
def business_counters(spark, sf):
    """Validation / geocoding / search success and failure counts per endpoint."""
    r = derived(spark, sf, "request_log")
    p = F.col("path")
    metric = (F.when(p.contains("/validate"), F.lit("address_validation"))
              .when(p.contains("/geocode"), F.lit("geocoding")).when(p.contains("/search"), F.lit("address_search")))
    b = r.select(metric.alias("m"), p.alias("endpoint"), (F.col("status_code") < 400).alias("ok"))
    b = b.filter(F.col("m").isNotNull())
    name = F.concat(F.col("m"), F.when(F.col("ok"), F.lit("_success")).otherwise(F.lit("_failure")))
    return b.groupBy(name.alias("metric"), "endpoint").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ A20-A27
def _stats(df, keys, period_s):
    """A20 statistics per key: mean, floor-index p95/p99, error %, rate, cache-hit %."""
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requests"),
        F.floor(F.avg("duration_ms") + 0.5).cast("long").alias("avg_ms"),
        _pct(F.count_if(F.col("status_code") >= 400) / F.count(F.lit(1))).alias("error_rate"),
        _r2c(F.count(F.lit(1)) / F.lit(float(period_s))).alias("throughput"),
        _pct(F.count_if(F.col("cache_hit")) / F.count(F.lit(1))).alias("cache_hit_ratio"),
    )
    pct = M.exact_percentiles(df, keys, "duration_ms", {"p95_ms": 0.95, "p99_ms": 0.99}, "floor")
    return agg.join(pct, list(keys))


@query("request_stats", O_LOG + f""", h AS (SELECT date_trunc('hour', ts) AS period_start, duration_ms, status_code,
  cache_hit, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY duration_ms) AS rn,
  count(*) OVER (PARTITION BY date_trunc('hour', ts)) AS n FROM rl)
SELECT strftime(period_start, '%Y-%m-%d %H:%M:%S.%f') AS period_start, count(*) AS requests,
  CAST(floor(avg(duration_ms) + 0.5) AS BIGINT) AS avg_ms,
  {_pct_sql('count(*) FILTER (WHERE status_code >= 400) / count(*)')} AS error_rate,
  {_r2('CAST(count(*) AS DOUBLE) / 3600')} AS throughput,
  {_pct_sql('count(*) FILTER (WHERE cache_hit) / count(*)')} AS cache_hit_ratio,
  max(duration_ms) FILTER (WHERE rn = floor(n * 0.95) + 1) AS p95_ms,
  max(duration_ms) FILTER (WHERE rn = floor(n * 0.99) + 1) AS p99_ms
FROM h GROUP BY period_start""")
def request_stats(spark, sf):
    """A20 + W8: hourly mean, p95/p99 (floor index), error %, requests/s, cache-hit %."""
    r = derived(spark, sf, "request_log").withColumn("period_start", F.date_trunc("hour", "ts"))
    return _stats(r, ["period_start"], 3600)


@query("top_endpoints", O_LOG + """, e AS (SELECT route AS endpoint, count(*) AS n, avg(duration_ms) AS a FROM rl GROUP BY 1)
SELECT endpoint, n AS requests, round(a, 4) AS avg_response_time,
       row_number() OVER (ORDER BY n DESC, endpoint) AS rank
FROM e QUALIFY rank <= 10""")
def top_endpoints(spark, sf):
    """A21 + T8: ten busiest routes with their mean response time (global top-k)."""
    r = log(spark, sf)
    e = r.groupBy(F.col("route").alias("endpoint")).agg(F.count(F.lit(1)).alias("requests"),
                                                       F.round(F.avg("duration_ms"), 4).alias("avg_response_time"))
    top = e.orderBy(F.desc("requests"), "endpoint").limit(10)
    from pyspark.sql import Window

    # the ten rows are numbered after the limit (a 10-row frame)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("requests"), "endpoint")).cast("long"))


ENDPOINT = "/api/v1/addresses/validate"
ENDPOINT_WINDOW_MIN = 1440


@query("endpoint_metrics", O_LOG + f""", e AS (SELECT duration_ms, status_code, cache_hit,
  row_number() OVER (ORDER BY duration_ms) AS rn, count(*) OVER () AS n FROM rl
  WHERE path = '{ENDPOINT}' AND ts >= TIMESTAMP '{AS_OF}' - INTERVAL {ENDPOINT_WINDOW_MIN} MINUTE
    AND ts < TIMESTAMP '{AS_OF}')
SELECT '{ENDPOINT}' AS endpoint, count(*) AS requests, CAST(floor(avg(duration_ms) + 0.5) AS BIGINT) AS avg_ms,
  {_pct_sql('count(*) FILTER (WHERE status_code >= 400) / count(*)')} AS error_rate,
  {_r2(f'CAST(count(*) AS DOUBLE) / {ENDPOINT_WINDOW_MIN * 60}')} AS throughput,
  {_pct_sql('count(*) FILTER (WHERE cache_hit) / count(*)')} AS cache_hit_ratio,
  max(duration_ms) FILTER (WHERE rn = floor(n * 0.95) + 1) AS p95_ms,
  max(duration_ms) FILTER (WHERE rn = floor(n * 0.99) + 1) AS p99_ms
FROM e""")
def endpoint_metrics(spark, sf):
    """One endpoint over the last 24 h before the as-of time."""
    r = derived(spark, sf, "request_log")
    end = F.lit(AS_OF).cast("timestamp_ntz")
    r = r.filter((F.col("path") == ENDPOINT) & (F.col("ts") >= end - F.expr(f"INTERVAL {ENDPOINT_WINDOW_MIN} MINUTES"))
                 & (F.col("ts") < end)).withColumn("endpoint", F.lit(ENDPOINT))
    return _stats(r, ["endpoint"], ENDPOINT_WINDOW_MIN * 60)


@query("load_summary", O_LOG + f""", d AS (SELECT CAST(ts AS DATE) AS day, duration_ms, status_code,
  row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY duration_ms) AS rn,
  count(*) OVER (PARTITION BY CAST(ts AS DATE)) AS n FROM rl)
SELECT CAST(day AS VARCHAR) AS day, count(*) AS total_requests,
  count(*) FILTER (WHERE status_code < 400) AS successful_requests,
  count(*) FILTER (WHERE status_code >= 400) AS failed_requests,
  round(avg(duration_ms), 4) AS average_response_time,
  max(duration_ms) FILTER (WHERE rn = greatest(ceil(n * 0.95), 1)) AS p95_response_time,
  max(duration_ms) FILTER (WHERE rn = greatest(ceil(n * 0.99), 1)) AS p99_response_time,
  max(duration_ms) AS max_response_time,
  round(CAST(count(*) AS DOUBLE) / 86400, 6) AS requests_per_second,
  round(CAST(count(*) FILTER (WHERE status_code >= 400) AS DOUBLE) / count(*) * 100, 4) AS error_rate
FROM d GROUP BY day""")
def load_summary(spark, sf):
    """Per day (a load run): totals, mean, nearest-rank p95/p99, max, rate, error %."""
    r = derived(spark, sf, "request_log").withColumn("day", F.to_date("ts"))
    agg = r.groupBy("day").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if(F.col("status_code") < 400).alias("successful_requests"),
        F.count_if(F.col("status_code") >= 400).alias("failed_requests"),
        F.round(F.avg("duration_ms"), 4).alias("average_response_time"),
        F.max("duration_ms").alias("max_response_time"),
        F.round(F.count(F.lit(1)) / F.lit(86400.0), 6).alias("requests_per_second"),
        F.round(F.count_if(F.col("status_code") >= 400) / F.count(F.lit(1)) * 100, 4).alias("error_rate"),
    )
    pct = M.exact_percentiles(r, ["day"], "duration_ms", {"p95_response_time": 0.95, "p99_response_time": 0.99},
                              "ceil")
    return agg.join(pct, "day")


@query("load_by_endpoint", O_LOG + """SELECT route AS endpoint, count(*) AS requests,
  round(avg(duration_ms), 4) AS average_response_time,
  round(CAST(count(*) FILTER (WHERE status_code >= 400) AS DOUBLE) / count(*) * 100, 4) AS error_rate
FROM rl GROUP BY route""")
def load_by_endpoint(spark, sf):
    """Per endpoint requests, mean time and error %."""
    r = log(spark, sf)
    return r.groupBy(F.col("route").alias("endpoint")).agg(
        F.count(F.lit(1)).alias("requests"), F.round(F.avg("duration_ms"), 4).alias("average_response_time"),
        F.round(F.count_if(F.col("status_code") >= 400) / F.count(F.lit(1)) * 100, 4).alias("error_rate"))


@query("load_score", O_LOG + f""", d AS (SELECT CAST(ts AS DATE) AS day,
  CAST(count(*) FILTER (WHERE status_code < 400) AS DOUBLE) / count(*) * 100 AS success_rate,
  avg(duration_ms) AS avg_ms FROM rl GROUP BY 1)
SELECT CAST(day AS VARCHAR) AS day, round(success_rate, 4) AS success_rate, round(avg_ms, 4) AS avg_ms,
  CAST(floor(least(50, success_rate / 100 * 50) + greatest(0, 50 - greatest(0, (avg_ms - 150) / 10)) + 0.5) AS BIGINT)
    AS performance_score,
  CAST(floor(greatest(0, 50 - greatest(0, (avg_ms - {BENCH_TARGET_MS}) / {BENCH_TARGET_MS} * 50))
             + success_rate / 100 * 50 + 0.5) AS BIGINT) AS benchmark_score,
  avg_ms <= {BENCH_TARGET_MS} AND success_rate >= 95 AS passed
FROM d""")
def load_score(spark, sf):
    """Performance score and benchmark score (target 500 ms) per day."""
    r = derived(spark, sf, "request_log").withColumn("day", F.to_date("ts"))
    d = r.groupBy("day").agg(
        (F.count_if(F.col("status_code") < 400) / F.count(F.lit(1)) * 100).alias("sr"),
        F.avg("duration_ms").alias("am"))
    sr, am = F.col("sr"), F.col("am")
    perf = F.least(F.lit(50.0), sr / 100 * 50) + F.greatest(F.lit(0.0), 50 - F.greatest(F.lit(0.0), (am - 150) / 10))
    bench = F.greatest(F.lit(0.0), 50 - F.greatest(F.lit(0.0), (am - BENCH_TARGET_MS) / BENCH_TARGET_MS * 50)) \
        + sr / 100 * 50
    return d.select("day", F.round(sr, 4).alias("success_rate"), F.round(am, 4).alias("avg_ms"),
                    F.floor(perf + 0.5).cast("long").alias("performance_score"),
                    F.floor(bench + 0.5).cast("long").alias("benchmark_score"),
                    ((am <= BENCH_TARGET_MS) & (sr >= 95)).alias("passed"))


@query("query_bench", O_LOG + """, q AS (SELECT route AS query_type, avg(duration_ms) AS mean_ms, max(duration_ms) AS max_ms,
  min(duration_ms) AS min_ms, count(*) AS n FROM rl GROUP BY 1),
o AS (SELECT greatest(0, least(1000, 1000 - avg(mean_ms))) AS score FROM q)
SELECT query_type, round(mean_ms, 4) AS mean_ms, max_ms, min_ms, n, round(score, 4) AS overall_score FROM q, o""")
def query_bench(spark, sf):
    """Per query type mean / max / min / n and the overall 1000 - mean-of-means score."""
    r = log(spark, sf)
    q = r.groupBy(F.col("route").alias("query_type")).agg(
        F.avg("duration_ms").alias("mean_ms"), F.max("duration_ms").alias("max_ms"),
        F.min("duration_ms").alias("min_ms"), F.count(F.lit(1)).alias("n"))
    o = q.agg(F.greatest(F.lit(0.0), F.least(F.lit(1000.0), 1000 - F.avg("mean_ms"))).alias("score"))
    return q.crossJoin(o).select("query_type", F.round("mean_ms", 4).alias("mean_ms"), "max_ms", "min_ms", "n",
                                 F.round("score", 4).alias("overall_score"))


SPATIAL_HISTORY = 1000


@query("spatial_query_stats", O_LOG + f""", h AS (SELECT duration_ms FROM rl WHERE starts_with(path, '/api/v1/spatial')
  ORDER BY ts DESC, request_id DESC LIMIT {SPATIAL_HISTORY})
SELECT round(avg(duration_ms), 4) AS average_time, count(*) FILTER (WHERE duration_ms > 500) AS slow_queries,
       count(*) AS total_queries FROM h""")
def spatial_query_stats(spark, sf):
    """A27 + W11: statistics over the last 1000 spatial requests (bounded history is the feature)."""
    r = derived(spark, sf, "request_log").filter(F.col("path").startswith("/api/v1/spatial"))
    h = r.orderBy(F.desc("ts"), F.desc("request_id")).limit(SPATIAL_HISTORY)
    return h.agg(F.round(F.avg("duration_ms"), 4).alias("average_time"),
                 F.count_if(F.col("duration_ms") > 500).alias("slow_queries"),
                 F.count(F.lit(1)).alias("total_queries"))


@query("cache_hit_ratio", O_LOG + """SELECT 'l1' AS layer, count(*) FILTER (WHERE cache_layer = 'l1') AS hits,
  count(*) AS lookups, round(CAST(count(*) FILTER (WHERE cache_layer = 'l1') AS DOUBLE) / count(*), 4) AS hit_ratio FROM rl
UNION ALL SELECT 'l2', count(*) FILTER (WHERE cache_layer = 'l2'), count(*) FILTER (WHERE cache_layer <> 'l1'),
  round(CAST(count(*) FILTER (WHERE cache_layer = 'l2') AS DOUBLE) / count(*) FILTER (WHERE cache_layer <> 'l1'), 4) FROM rl
UNION ALL SELECT 'overall', count(*) FILTER (WHERE cache_layer <> 'miss'), count(*),
  round(CAST(count(*) FILTER (WHERE cache_layer <> 'miss') AS DOUBLE) / count(*), 4) FROM rl""")
def cache_hit_ratio(spark, sf):
    """Hit ratio per cache layer (L2 sees L1 misses) and overall."""
    r = derived(spark, sf, "request_log")
    lay = F.col("cache_layer")
    a = r.agg(F.count(F.lit(1)).alias("n"), F.count_if(lay == "l1").alias("l1"), F.count_if(lay == "l2").alias("l2"))
    return a.select(F.explode(F.array(
        F.struct(F.lit("l1").alias("layer"), F.col("l1").alias("hits"), F.col("n").alias("lookups")),
        F.struct(F.lit("l2").alias("layer"), F.col("l2").alias("hits"), (F.col("n") - F.col("l1")).alias("lookups")),
        F.struct(F.lit("overall").alias("layer"), (F.col("l1") + F.col("l2")).alias("hits"), F.col("n").alias("lookups")),
    )).alias("s")).select("s.layer", "s.hits", "s.lookups",
                          F.round(F.col("s.hits") / F.col("s.lookups"), 4).alias("hit_ratio"))


def _hist(spark, sf):
    r = log(spark, sf)
    return M.cumulative_histogram(r, ["route"], F.col("duration_ms") / 1000.0, HIST_BOUNDS)


_BOUNDS_SQL = ", ".join(f"(CAST({b!r} AS DOUBLE))" for b in HIST_BOUNDS) + ", (CAST('Infinity' AS DOUBLE))"
O_HIST = O_LOG + f""", b AS (SELECT * FROM (VALUES {_BOUNDS_SQL}) AS t(le)),
hist AS (SELECT r.route, b.le, count(*) FILTER (WHERE CAST(r.duration_ms AS DOUBLE) / 1000 <= b.le) AS cumulative_count
         FROM rl r CROSS JOIN b GROUP BY 1, 2)
"""


@query("latency_histogram", O_HIST + "SELECT route, le, cumulative_count FROM hist")
def latency_histogram(spark, sf):
    """Cumulative latency histogram (seconds) per route with the request-duration bounds."""
    return _hist(spark, sf)


@query("histogram_quantile", O_HIST + """, h2 AS (
  SELECT *, coalesce(lag(le) OVER (PARTITION BY route ORDER BY le), 0) AS prev_le,
         coalesce(lag(cumulative_count) OVER (PARTITION BY route ORDER BY le), 0) AS prev_cum,
         max(cumulative_count) OVER (PARTITION BY route) AS total
  FROM hist),
qs AS (SELECT * FROM (VALUES (0.5), (0.95)) AS t(q)),
f AS (SELECT qs.q, h2.*, q * total AS rnk,
             row_number() OVER (PARTITION BY qs.q, route ORDER BY le) AS k
      FROM h2 CROSS JOIN qs WHERE cumulative_count >= q * total AND total > 0)
SELECT route, q AS quantile_level,
       round(CASE WHEN isinf(le) THEN prev_le ELSE prev_le + (le - prev_le) * (rnk - prev_cum) / (cumulative_count - prev_cum) END, 6)
         AS quantile
FROM f WHERE k = 1""")
def histogram_quantile(spark, sf):
    """p50 and p95 per route from the cumulative histogram, with linear interpolation."""
    h = _hist(spark, sf)
    out = None
    for q in (0.5, 0.95):
        part = M.histogram_quantile(h, ["route"], q).select(
            "route", F.lit(q).alias("quantile_level"), F.round("quantile", 6).alias("quantile"))
        out = part if out is None else out.unionByName(part)
    return out


# ------------------------------------------------------------ W2, W3
MOVING_N = 100


def _positioned(spark, sf):
    r = log(spark, sf).select("request_id", "ts", "route", "duration_ms")
    return M.positions(r, ["route"], ["ts", "request_id"], F.date_trunc("day", "ts"))


O_POS = O_LOG + """, pos AS (SELECT request_id, route, duration_ms,
  row_number() OVER (PARTITION BY route ORDER BY ts, request_id) AS g FROM rl)
"""


@query("moving_avg", O_POS + f"""SELECT request_id, route, round(avg(duration_ms) OVER (PARTITION BY route ORDER BY g
  ROWS BETWEEN {MOVING_N - 1} PRECEDING AND CURRENT ROW), 4) AS moving_avg FROM pos""")
def moving_avg(spark, sf):
    """Mean duration of the last 100 requests per route (block + halo windows)."""
    p = _positioned(spark, sf)
    out = M.moving_average(p, ["route"], "duration_ms", MOVING_N)
    return out.select("request_id", "route", F.round("moving_avg", 4).alias("moving_avg"))


def _ema_sql(alpha: float, seeded: bool):
    """Closed form over the whole history; with ``seeded`` the first value enters with its full weight."""
    first = f"WHEN s.g = 1 THEN pow({1 - alpha}, r.g - 1) " if seeded else ""
    return f""", e AS (
  SELECT r.request_id, r.route,
         sum(CASE {first}WHEN true THEN {alpha} * pow({1 - alpha}, r.g - s.g) END * s.duration_ms) AS ema
  FROM pos r JOIN pos s ON s.route = r.route AND s.g <= r.g GROUP BY 1, 2)
SELECT request_id, route, round(ema, 6) AS ema FROM e"""


@query("ema", O_POS + _ema_sql(0.2, True))
def ema(spark, sf):
    """Exponential moving average (0.8 old + 0.2 new, seeded with the first value) per route."""
    out = M.ema(_positioned(spark, sf), ["route"], "duration_ms", 0.2)
    return out.select("request_id", "route", F.round("ema", 6).alias("ema"))


@query("ema_even", O_POS + _ema_sql(0.5, False))
def ema_even(spark, sf):
    """The variant that averages the old mean and the new value evenly, from 0."""
    out = M.ema(_positioned(spark, sf), ["route"], "duration_ms", 0.5, seed=0.0)
    return out.select("request_id", "route", F.round("ema", 6).alias("ema"))


# ------------------------------------------------------------ X25-X27, S21, S22, T8
LOG_SCHEMA = ("timestamp STRING, level STRING, message STRING, requestId STRING, ip STRING, duration STRING, "
              "performanceLog BOOLEAN, securityLog BOOLEAN, slowQueryLog BOOLEAN, businessMetric BOOLEAN, "
              "cacheMissLog BOOLEAN, errorName STRING")


# Fixed value: a line that matches begins an event.
START_LINE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
STITCH_CHUNK = 100_000


def stitched_lines(lines):
    """S20 on numbered lines: each event's first line with ``stack``, the lines after it (null if none).

    Events are numbered by a running count inside chunks of line numbers plus the counts of earlier chunks, so that a long
    log spreads over tasks; each event is then a group of its own lines. Lines before a file's first event are left out.
    """
    d = lines.withColumn("is_start", F.col("line").rlike(START_LINE).cast("int"))
    d = Q.running_count(d, "file", ["line_no"], F.floor(F.col("line_no") / STITCH_CHUNK), "is_start").where("_count > 0")
    more = F.array_sort(F.collect_list(F.when(F.col("is_start") == 0, F.struct("line_no", "line"))))
    e = d.groupBy("file", "_count").agg(F.min("line_no").alias("line_no"), F.max(F.when(F.col("is_start") == 1, F.col("line"))).alias("line"),
                                        more.alias("more"))
    stack = F.when(F.size("more") > 0, F.array_join(F.transform("more", lambda x: x["line"]), "\n"))
    return e.select("file", "line_no", "line", stack.alias("stack"))


def parse_log_lines(lines):
    """JSON payload of start lines -> typed columns, category, priority (later rule wins), type."""
    starts = lines.filter(F.col("line").rlike(START_LINE))
    keep = ["file", "line_no", *[c for c in ("stack",) if c in lines.columns]]
    j = starts.select(*keep, F.from_json(F.regexp_extract("line", r"^\S+ \S+ (\{.*)$", 1), LOG_SCHEMA).alias("j"))
    c = F.col
    level = c("j.level")
    category = F.when(level == "error", "error").when(level == "warn", "warning").otherwise("info")
    prio = F.when(level == "error", "high").when(level == "warn", "medium").otherwise("low")
    prio = F.when(c("j.securityLog"), F.lit("critical")).otherwise(prio)
    prio = F.when(c("j.slowQueryLog"), F.lit("medium")).otherwise(prio)  # applied later, wins
    ltype = F.lit(None).cast("string")
    for flag, name in (("performanceLog", "performance"), ("securityLog", "security"),
                       ("slowQueryLog", "database_performance"), ("businessMetric", "business_metrics"),
                       ("cacheMissLog", "cache_performance")):
        ltype = F.when(c(f"j.{flag}"), F.lit(name)).otherwise(ltype)
    return j.select(
        *keep,
        F.try_to_timestamp(c("j.timestamp"), F.lit("yyyy-MM-dd HH:mm:ss.SSS")).cast("timestamp_ntz").alias("ts"),
        c("j.level").alias("level"), c("j.requestId").alias("correlation_id"), c("j.ip").alias("ip"),
        c("j.duration").try_cast("int").alias("duration"), category.alias("log_category"),
        prio.alias("alert_priority"), ltype.alias("log_type"), c("j.errorName").alias("error_name"))


O_LINES = cte("log_lines") + """,
starts AS (SELECT file, line_no, regexp_extract(line, '^\\S+ \\S+ (\\{.*)$', 1) AS js FROM log_lines
           WHERE regexp_matches(line, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')),
parsed AS (
  SELECT file, line_no, strptime(json_extract_string(js, '$.timestamp'), '%Y-%m-%d %H:%M:%S.%g') AS ts,
         json_extract_string(js, '$.level') AS level, json_extract_string(js, '$.requestId') AS correlation_id,
         json_extract_string(js, '$.ip') AS ip, TRY_CAST(json_extract_string(js, '$.duration') AS INTEGER) AS duration,
         CASE json_extract_string(js, '$.level') WHEN 'error' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'info' END
           AS log_category,
         CASE WHEN coalesce(CAST(json_extract(js, '$.slowQueryLog') AS BOOLEAN), false) THEN 'medium'
              WHEN coalesce(CAST(json_extract(js, '$.securityLog') AS BOOLEAN), false) THEN 'critical'
              WHEN json_extract_string(js, '$.level') = 'error' THEN 'high'
              WHEN json_extract_string(js, '$.level') = 'warn' THEN 'medium' ELSE 'low' END AS alert_priority,
         CASE WHEN coalesce(CAST(json_extract(js, '$.cacheMissLog') AS BOOLEAN), false) THEN 'cache_performance'
              WHEN coalesce(CAST(json_extract(js, '$.businessMetric') AS BOOLEAN), false) THEN 'business_metrics'
              WHEN coalesce(CAST(json_extract(js, '$.slowQueryLog') AS BOOLEAN), false) THEN 'database_performance'
              WHEN coalesce(CAST(json_extract(js, '$.securityLog') AS BOOLEAN), false) THEN 'security'
              WHEN coalesce(CAST(json_extract(js, '$.performanceLog') AS BOOLEAN), false) THEN 'performance' END
           AS log_type,
         json_extract_string(js, '$.errorName') AS error_name
  FROM starts)
"""


def _lines(spark, sf):
    return parse_log_lines(derived(spark, sf, "log_lines"))


@query("log_categories", O_LINES + f""", marked AS (
  SELECT *, regexp_matches(line, '{START_LINE}') AS is_start,
         count(*) FILTER (WHERE regexp_matches(line, '{START_LINE}')) OVER (PARTITION BY file ORDER BY line_no) AS ev FROM log_lines),
stacks AS (SELECT file, min(line_no) AS line_no, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT is_start) AS stack
           FROM marked WHERE ev > 0 GROUP BY file, ev)
SELECT p.file, p.line_no, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, level, correlation_id, ip, CAST(duration AS BIGINT) AS duration,
       log_category, alert_priority, log_type, error_name, s.stack
FROM parsed p JOIN stacks s ON s.file = p.file AND s.line_no = p.line_no""")
def log_categories(spark, sf):
    """X25 + X26 + X27: parsed log events with category, priority and type, and their stack lines."""
    return parse_log_lines(stitched_lines(derived(spark, sf, "log_lines")))


@query("route_alert_logs", O_LINES + """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS log_events,
  count(*) FILTER (WHERE alert_priority IN ('high', 'critical')) AS alert_events FROM parsed GROUP BY 1""")
def route_alert_logs(spark, sf):
    """Events per daily log index and the high/critical copies routed to the alert index."""
    p = _lines(spark, sf)
    return p.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("log_events"),
        F.count_if(F.col("alert_priority").isin("high", "critical")).alias("alert_events"))


@query("retention_keep", O_LINES + f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS log_events FROM parsed
WHERE CAST(ts AS DATE) >= DATE '{RETENTION_AS_OF}' - INTERVAL {RETENTION_DAYS} DAY GROUP BY 1""")
def retention_keep(spark, sf):
    """Daily partitions kept by the 7-day retention (partition filter on the day column)."""
    p = _lines(spark, sf).withColumn("day", F.to_date("ts"))
    keep = p.filter(F.col("day") >= F.date_sub(F.lit(RETENTION_AS_OF).cast("date"), RETENTION_DAYS))
    return keep.groupBy("day").agg(F.count(F.lit(1)).alias("log_events"))


@query("top_error_types", O_LINES + """SELECT error_name, count(*) AS n,
  row_number() OVER (ORDER BY count(*) DESC, error_name) AS rank
FROM parsed WHERE error_name IS NOT NULL GROUP BY error_name QUALIFY rank <= 10""")
def top_error_types(spark, sf):
    """Ten most frequent error names."""
    from pyspark.sql import Window

    p = _lines(spark, sf).filter(F.col("error_name").isNotNull())
    top = p.groupBy("error_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "error_name").limit(10)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "error_name")).cast("long"))
