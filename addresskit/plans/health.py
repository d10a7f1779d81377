"""Dataset and service health checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .alerts import threshold_alerts, tiered_sql
from .logs import AS_OF as LOG_AS_OF
from .logs import O_LOG
from .registry import ORACLES, query

HEALTH_AS_OF = "1999-01-01"
MIN_ADDRESSES = 1000000
STALE_DAYS = 100
DUE_DAYS = 90
ALERT_HISTORY = 1000

O = C.O_REGISTER


def _freshness(spark, sf) -> DataFrame:
    a = C.addresses(spark, sf).filter(F.col("address_status") == "CURRENT")
    per_day = a.groupBy("gnaf_date_created").agg(F.count(F.lit(1)).alias("n"))  # one row per load date
    agg = per_day.agg(F.max("gnaf_date_created").alias("last_import_date"),
                      F.max_by("n", "gnaf_date_created").alias("last_import_records"),
                      F.sum("n").alias("total_records"))
    as_of = F.lit(HEALTH_AS_OF).cast("date")
    days = F.when(F.col("last_import_date").isNull(), F.lit(999)).otherwise(
        F.datediff(as_of, F.col("last_import_date")))
    nxt = F.date_add(F.add_months(F.trunc(as_of, "quarter"), 3), 14)
    out = agg.select("last_import_date", F.coalesce("last_import_records", F.lit(0)).alias("last_import_records"),
                     F.coalesce("total_records", F.lit(0)).alias("total_records"),
                     days.alias("days_since_last_import"))
    return out.select(
        "*", (F.col("days_since_last_import") > STALE_DAYS).alias("is_stale"),
        (F.col("days_since_last_import") > DUE_DAYS).alias("quarterly_update_due"),
        nxt.alias("next_expected_update"))


@query("dataset_freshness", O + f""", per_day AS (SELECT gnaf_date_created AS d, count(*) AS n FROM addresses
  WHERE address_status = 'CURRENT' GROUP BY 1),
f AS (SELECT max(d) AS last_import_date, arg_max(n, d) AS last_import_records, sum(n) AS total_records FROM per_day)
SELECT last_import_date, CAST(coalesce(last_import_records, 0) AS BIGINT) AS last_import_records,
  CAST(coalesce(total_records, 0) AS BIGINT) AS total_records,
  CAST(CASE WHEN last_import_date IS NULL THEN 999
            ELSE date_diff('day', CAST(last_import_date AS DATE), DATE '{HEALTH_AS_OF}') END AS BIGINT) AS days_since_last_import,
  coalesce(date_diff('day', CAST(last_import_date AS DATE), DATE '{HEALTH_AS_OF}'), 999) > {STALE_DAYS} AS is_stale,
  coalesce(date_diff('day', CAST(last_import_date AS DATE), DATE '{HEALTH_AS_OF}'), 999) > {DUE_DAYS} AS quarterly_update_due,
  CAST(CAST(date_trunc('quarter', DATE '{HEALTH_AS_OF}') + INTERVAL 3 MONTH + INTERVAL 14 DAY AS DATE) AS VARCHAR)
    AS next_expected_update
FROM f""")
def dataset_freshness(spark, sf):
    """A14 + J20: last load date and its row count (one pass over per-date counts), staleness, next quarterly release."""
    return _freshness(spark, sf)


def _integrity(spark, sf) -> DataFrame:
    a = C.addresses(spark, sf).filter(F.col("address_status") == "CURRENT")
    g = a.agg(F.count(F.lit(1)).alias("total_addresses"),
              F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("missing_coordinates"),
              F.count_if(F.col("locality_pid").isNull()).alias("missing_locality"),
              F.count_if(F.col("confidence_score") < 50).alias("low_confidence"))
    t = F.col("total_addresses")

    def pct(missing):
        return F.when(t > 0, (t - F.col(missing)) / t * 100).otherwise(F.lit(0.0))

    g = g.select("*", pct("missing_coordinates").alias("coordinate_completeness"),
                 pct("missing_locality").alias("locality_completeness"),
                 pct("low_confidence").alias("confidence_rate"))
    cc, lc, cr = F.col("coordinate_completeness"), F.col("locality_completeness"), F.col("confidence_rate")
    status = (F.when((cc < 90) | (lc < 95) | (cr < 70), F.lit("fail"))
              .when((cc < 95) | (lc < 98) | (cr < 80), F.lit("warn")).otherwise(F.lit("pass")))
    return g.select("total_addresses", F.round(cc, 4).alias("coordinate_completeness"),
                    F.round(lc, 4).alias("locality_completeness"), F.round(cr, 4).alias("confidence_rate"),
                    status.alias("status"))


_O_INTEGRITY = """, ig AS (SELECT count(*) AS t, count(*) FILTER (WHERE latitude IS NULL OR longitude IS NULL) AS mc,
  count(*) FILTER (WHERE locality_pid IS NULL) AS ml, count(*) FILTER (WHERE confidence_score < 50) AS lc
  FROM addresses WHERE address_status = 'CURRENT'),
ig2 AS (SELECT t, CASE WHEN t > 0 THEN CAST(t - mc AS DOUBLE) / t * 100 ELSE 0 END AS cc,
               CASE WHEN t > 0 THEN CAST(t - ml AS DOUBLE) / t * 100 ELSE 0 END AS lcp,
               CASE WHEN t > 0 THEN CAST(t - lc AS DOUBLE) / t * 100 ELSE 0 END AS cr FROM ig),
integrity AS (SELECT t AS total_addresses, round(cc, 4) AS coordinate_completeness, round(lcp, 4) AS locality_completeness,
  round(cr, 4) AS confidence_rate,
  CASE WHEN cc < 90 OR lcp < 95 OR cr < 70 THEN 'fail' WHEN cc < 95 OR lcp < 98 OR cr < 80 THEN 'warn' ELSE 'pass' END
    AS status FROM ig2)
"""


@query("integrity_health", O + _O_INTEGRITY + "SELECT * FROM integrity")
def integrity_health(spark, sf):
    """Coordinate / locality completeness and confidence rate of CURRENT addresses; pass / warn / fail."""
    return _integrity(spark, sf)


def _dataset(spark, sf) -> DataFrame:
    a = C.addresses(spark, sf)
    as_of = F.lit(HEALTH_AS_OF).cast("date")
    g = a.agg(F.count(F.lit(1)).alias("total_addresses"), F.max("gnaf_date_created").alias("last_updated"),
              F.min("gnaf_date_created").alias("first_created"),
              F.count_if(F.col("gnaf_date_created") > F.add_months(as_of, -6)).alias("recent_addresses"))
    recent = F.col("recent_addresses") > 0
    minimum = F.col("total_addresses") > MIN_ADDRESSES
    warnings = F.concat_ws("; ", F.when(~recent, F.lit("No recent address updates in last 6 months")),
                           F.when(~minimum, F.lit("Insufficient address data for reliable service")))
    return g.select("total_addresses", "recent_addresses", "last_updated", "first_created",
                    F.when(recent, "current").otherwise("stale").alias("data_freshness"),
                    F.when(recent & minimum, "healthy").otherwise("degraded").alias("status"),
                    warnings.alias("warnings"), minimum.cast("int").alias("health_gauge"))


_O_DATASET = f""", ds AS (SELECT count(*) AS total_addresses,
  count(*) FILTER (WHERE CAST(gnaf_date_created AS DATE) > DATE '{HEALTH_AS_OF}' - INTERVAL 6 MONTH) AS recent_addresses,
  max(gnaf_date_created) AS last_updated, min(gnaf_date_created) AS first_created FROM addresses),
dataset AS (SELECT total_addresses, recent_addresses, last_updated, first_created,
  CASE WHEN recent_addresses > 0 THEN 'current' ELSE 'stale' END AS data_freshness,
  CASE WHEN recent_addresses > 0 AND total_addresses > {MIN_ADDRESSES} THEN 'healthy' ELSE 'degraded' END AS status,
  concat_ws('; ', CASE WHEN recent_addresses = 0 THEN 'No recent address updates in last 6 months' END,
            CASE WHEN total_addresses <= {MIN_ADDRESSES} THEN 'Insufficient address data for reliable service' END)
    AS warnings,
  CAST(CASE WHEN total_addresses > {MIN_ADDRESSES} THEN 1 ELSE 0 END AS BIGINT) AS health_gauge FROM ds)
"""


@query("dataset_health", O + _O_DATASET + "SELECT * FROM dataset")
def dataset_health(spark, sf):
    """A16 + A17: size, first/last load date, rows of the last 6 months; healthy above 1,000,000 rows."""
    return _dataset(spark, sf)


ERROR_WINDOW_H = 24


def _error_check(spark, sf) -> DataFrame:
    from ..sources.fixtures import derived

    r = derived(spark, sf, "request_log")
    end = F.lit(LOG_AS_OF).cast("timestamp_ntz")
    r = r.filter((F.col("ts") >= end - F.expr(f"INTERVAL {ERROR_WINDOW_H} HOURS")) & (F.col("ts") < end))
    g = r.agg(F.coalesce(F.try_divide(F.count_if(F.col("status_code") >= 400) * 100.0, F.count(F.lit(1))),
                         F.lit(0.0)).alias("e"))
    return g.select(F.lit("Request Errors").alias("check_name"),
                    F.when(F.col("e") > 10, "fail").when(F.col("e") > 5, "warn").otherwise("pass").alias("status"),
                    F.concat(F.lit("Error rate is "), F.format_string("%.2f", F.col("e")), F.lit("%")).alias("message"))


def _checks(spark, sf) -> DataFrame:
    ig = _integrity(spark, sf).select(
        F.lit("Data Integrity").alias("check_name"), "status",
        F.when(F.col("status") == "fail", "Data integrity issues detected")
        .when(F.col("status") == "warn", "Minor data integrity concerns")
        .otherwise("Data integrity is good").alias("message"))
    ds = _dataset(spark, sf).select(
        F.lit("Dataset").alias("check_name"),
        F.when(F.col("status") == "healthy", "pass").otherwise("warn").alias("status"),
        F.when(F.col("warnings") == "", F.lit("Dataset is healthy")).otherwise(F.col("warnings")).alias("message"))
    fr = _freshness(spark, sf).select(
        F.lit("Dataset Freshness").alias("check_name"),
        F.when(F.col("is_stale"), "fail").when(F.col("quarterly_update_due"), "warn").otherwise("pass").alias("status"),
        F.concat(F.lit("Dataset is "), F.col("days_since_last_import").cast("string"), F.lit(" days old"))
        .alias("message"))
    return ig.unionByName(ds).unionByName(fr).unionByName(_error_check(spark, sf))


_O_CHECKS = _O_INTEGRITY + _O_DATASET + f""", per_day AS (SELECT gnaf_date_created AS d FROM addresses
  WHERE address_status = 'CURRENT'),
fr AS (SELECT coalesce(date_diff('day', CAST(max(d) AS DATE), DATE '{HEALTH_AS_OF}'), 999) AS days FROM per_day),
rl AS (SELECT * FROM request_log WHERE ts >= TIMESTAMP '{LOG_AS_OF}' - INTERVAL {ERROR_WINDOW_H} HOUR
       AND ts < TIMESTAMP '{LOG_AS_OF}'),
er AS (SELECT coalesce(CAST(count(*) FILTER (WHERE status_code >= 400) AS DOUBLE) * 100 / nullif(count(*), 0), 0) AS e FROM rl),
checks AS (
  SELECT 'Data Integrity' AS check_name, status,
         CASE status WHEN 'fail' THEN 'Data integrity issues detected' WHEN 'warn' THEN 'Minor data integrity concerns'
              ELSE 'Data integrity is good' END AS message FROM integrity
  UNION ALL SELECT 'Dataset', CASE WHEN status = 'healthy' THEN 'pass' ELSE 'warn' END,
         CASE WHEN warnings = '' THEN 'Dataset is healthy' ELSE warnings END FROM dataset
  UNION ALL SELECT 'Dataset Freshness', CASE WHEN days > {STALE_DAYS} THEN 'fail' WHEN days > {DUE_DAYS} THEN 'warn'
         ELSE 'pass' END, 'Dataset is ' || CAST(days AS VARCHAR) || ' days old' FROM fr
  UNION ALL SELECT 'Request Errors', CASE WHEN e > 10 THEN 'fail' WHEN e > 5 THEN 'warn' ELSE 'pass' END,
         'Error rate is ' || printf('%.2f', e) || '%' FROM er)
"""
_O_HEALTH_BASE = C.register_sql("request_log") + _O_CHECKS


@query("health_rollup", _O_HEALTH_BASE + """, c AS (SELECT count(*) FILTER (WHERE status = 'fail') AS f,
  count(*) FILTER (WHERE status = 'warn') AS w, count(*) AS t FROM checks)
SELECT CASE WHEN f > 0 THEN 'unhealthy' WHEN w > 0 THEN 'degraded' ELSE 'healthy' END AS status,
  CAST(CASE WHEN f = 0 AND w = 0 THEN 100 WHEN f = 0 THEN floor(CAST(t - w AS DOUBLE) / t * 100 + 0.5)
            ELSE floor(CAST(t - f - w AS DOUBLE) / t * 100 + 0.5) END AS BIGINT) AS overall_score,
  f AS failed_checks, w AS warning_checks, t AS total_checks FROM c""")
def health_rollup(spark, sf):
    """Worst-of status over the checks and the share-of-passing score."""
    c = _checks(spark, sf).agg(F.count_if(F.col("status") == "fail").alias("f"),
                               F.count_if(F.col("status") == "warn").alias("w"), F.count(F.lit(1)).alias("t"))
    f, w, t = F.col("f"), F.col("w"), F.col("t")
    score = (F.when((f == 0) & (w == 0), F.lit(100.0)).when(f == 0, F.floor((t - w) / t * 100 + 0.5))
             .otherwise(F.floor((t - f - w) / t * 100 + 0.5)))
    return c.select(F.when(f > 0, "unhealthy").when(w > 0, "degraded").otherwise("healthy").alias("status"),
                    score.cast("long").alias("overall_score"), f.alias("failed_checks"), w.alias("warning_checks"),
                    t.alias("total_checks"))


@query("check_alerts", _O_HEALTH_BASE + """SELECT check_name,
  CASE WHEN status = 'fail' THEN 'critical' ELSE 'warning' END AS severity,
  CASE WHEN status = 'fail' THEN 'connectivity' ELSE 'performance' END AS alert_type,
  CASE WHEN status = 'fail' THEN 'Health check failed: ' ELSE 'Health check warning: ' END || check_name || ' - ' || message
    AS message, false AS resolved
FROM checks WHERE status <> 'pass'""")
def check_alerts(spark, sf):
    """One alert per non-passing check (fail -> critical, warn -> warning), unresolved."""
    c = _checks(spark, sf).filter(F.col("status") != "pass")
    fail = F.col("status") == "fail"
    return c.select(
        "check_name", F.when(fail, "critical").otherwise("warning").alias("severity"),
        F.when(fail, "connectivity").otherwise("performance").alias("alert_type"),
        F.concat(F.when(fail, F.lit("Health check failed: ")).otherwise(F.lit("Health check warning: ")),
                 F.col("check_name"), F.lit(" - "), F.col("message")).alias("message"),
        F.lit(False).alias("resolved"))


@query("recent_alerts")
def recent_alerts(spark, sf):
    """Performance alerts of the last 24 h before the as-of time, newest first, at most 1000 kept."""
    a = threshold_alerts(spark, sf)
    end = F.lit(LOG_AS_OF).cast("timestamp_ntz")
    a = a.filter((F.col("window_start") >= end - F.expr("INTERVAL 24 HOURS")) & (F.col("window_start") < end))
    top = a.orderBy(F.desc("window_start"), "alert_type").limit(ALERT_HISTORY)
    return top.select("window_start", "alert_type", "severity", "threshold", "value",
                      F.lit(False).alias("resolved"))


ORACLES["recent_alerts"] = O_LOG + tiered_sql() + f"""SELECT strftime(ws, '%Y-%m-%d %H:%M:%S.%f') AS window_start, alert_type,
       severity, CAST(threshold AS DOUBLE) AS threshold, value, false AS resolved
FROM a WHERE severity IS NOT NULL AND ws >= TIMESTAMP '{LOG_AS_OF}' - INTERVAL 24 HOUR AND ws < TIMESTAMP '{LOG_AS_OF}'
ORDER BY ws DESC, alert_type LIMIT {ALERT_HISTORY}"""
