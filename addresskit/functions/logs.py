"""Request-log column functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Exact route names kept as they are, per section.
HEALTH_ROUTES = ["/api/v1/health", "/api/v1/health/detailed", "/api/v1/health/ready", "/api/v1/health/live",
                 "/api/v1/health/metrics"]
ADDRESS_ROUTES = ["/api/v1/addresses/search", "/api/v1/addresses/validate", "/api/v1/addresses/geocode",
                  "/api/v1/addresses/reverse-geocode", "/api/v1/addresses/batch-validate"]
SPATIAL_ROUTES = ["/api/v1/spatial/proximity", "/api/v1/spatial/boundaries", "/api/v1/spatial/statistics",
                  "/api/v1/spatial/coverage"]
ADMIN_ROUTES = ["/api/v1/admin/status", "/api/v1/admin/cache/warm", "/api/v1/admin/cache/clear",
                "/api/v1/admin/dataset", "/api/v1/admin/dataset-refresh"]
PID_ROUTE_PATTERN = r"/api/v1/addresses/[A-Z0-9]+$"

# Request priority patterns ('*' = any text), checked high then medium.
PRIORITY_HIGH = ["/api/v1/health", "/api/v1/addresses/validate"]
PRIORITY_MEDIUM = ["/api/v1/addresses/*", "/api/v1/spatial/*"]

# Suspicious input patterns (case-insensitive).
SUSPICIOUS_PATTERNS = [
    r"\b(union|select|insert|update|delete|drop|exec|script)\b",
    r"<script[^>]*>.*?</script>",
    r"javascript:",
    r"vbscript:",
    r"on\w+\s*=",
]

# Body keys whose values are redacted, and the marker.
SENSITIVE_KEYS = ["password", "passwd", "pwd", "secret", "token", "key", "auth", "authorization", "credential",
                  "api_key", "apikey", "access_token", "refresh_token", "jwt", "session", "cookie"]
REDACTED = "***REDACTED***"

# Load-level thresholds (error %, mean ms, cpu %, memory %).
LOAD_LEVELS = [
    ("emergency", 20, 5000, 90, 95),
    ("minimal", 10, 2000, 80, 85),
    ("reduced", 5, 1000, 70, 75),
]


def route_pattern(path: Column) -> Column:
    """Normalised route label."""
    def section(prefix: str, exact: list[str], fallback: str, extra=None):
        rule = F.when(path.isin(*exact), path)
        if extra is not None:
            rule = rule.when(extra[0], F.lit(extra[1]))
        return F.when(path.startswith(prefix), rule.otherwise(F.lit(fallback)))

    return F.coalesce(
        section("/api/v1/health", HEALTH_ROUTES, "/api/v1/health/*"),
        section("/api/v1/addresses", ADDRESS_ROUTES, "/api/v1/addresses/*",
                (path.rlike(PID_ROUTE_PATTERN), "/api/v1/addresses/:gnaf_pid")),
        section("/api/v1/spatial", SPATIAL_ROUTES, "/api/v1/spatial/*"),
        section("/api/v1/admin", ADMIN_ROUTES, "/api/v1/admin/*"),
        F.when(path.startswith("/api/docs"), F.lit("/api/docs")),
        path,
    )


def endpoint_type(path: Column) -> Column:
    """Health / admin / api."""
    return (F.when(path.startswith("/api/v1/health"), F.lit("health"))
            .when(path.startswith("/api/v1/admin"), F.lit("admin")).otherwise(F.lit("api")))


def _glob_regex(p: str) -> str:
    return p.replace("*", ".*")


def request_priority(path: Column) -> Column:
    """High / medium / low by wildcard patterns (substring match)."""
    high = F.lit(False)
    for p in PRIORITY_HIGH:
        high = high | path.rlike(_glob_regex(p))
    med = F.lit(False)
    for p in PRIORITY_MEDIUM:
        med = med | path.rlike(_glob_regex(p))
    return F.when(high, F.lit("high")).when(med, F.lit("medium")).otherwise(F.lit("low"))


def is_suspicious(text: Column) -> Column:
    """any of the five suspicious patterns, case-insensitive."""
    out = F.lit(False)
    for p in SUSPICIOUS_PATTERNS:
        out = out | text.rlike("(?i)" + p)
    return out


def request_flags(duration_ms: Column, response_bytes: Column, status: Column) -> list[Column]:
    """slow (> 1000 ms), large (> 1 MB), error (>= 400)."""
    return [
        (duration_ms > 1000).alias("is_slow"),
        (response_bytes > 1024 * 1024).alias("is_large"),
        (status >= 400).alias("is_error"),
    ]


def mask_query(q: Column) -> Column:
    """Quoted strings -> '***', numbers of 4+ digits -> ***, first 500 characters."""
    x = F.regexp_replace(q, r"(['\"])[^'\"]*\1", "$1***$1")
    x = F.regexp_replace(x, r"\b\d{4,}\b", "***")
    return F.substring(x, 1, 500)


def mask_key(k: Column) -> Column:
    """User / session / email parts masked, first 200 characters."""
    x = F.regexp_replace(k, r"user:\d+", "user:***")
    x = F.regexp_replace(x, r"session:[a-f0-9-]+", "session:***")
    x = F.regexp_replace(x, r"email:[^:]+", "email:***")
    return F.substring(x, 1, 200)


def _redacted(value):
    if isinstance(value, dict):
        return {k: REDACTED if k in SENSITIVE_KEYS else _redacted(v) for k, v in value.items()}
    return [_redacted(v) for v in value] if isinstance(value, list) else value


def _redact_body(body: str | None) -> str | None:
    if body is None:
        return None
    try:
        return json.dumps(_redacted(json.loads(body)), separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return REDACTED


@F.pandas_udf(StringType())
def _redact(bodies: pd.Series) -> pd.Series:
    return bodies.map(_redact_body)


def redact_json(js: Column) -> Column:
    """The value of a sensitive key at any depth -> marker, whatever is nested in it.

    The body is parsed, not matched by pattern: SQL has no function that walks nested JSON of unknown shape.
    A body that cannot be parsed is replaced whole, so that nothing leaks; null stays null.
    """
    return _redact(js)


def load_level(error_pct: Column, mean_ms: Column, cpu: Column, mem: Column) -> Column:
    """Emergency / minimal / reduced / normal, first matching threshold set."""
    rule = None
    for name, e, r, c, m in LOAD_LEVELS:
        cond = (error_pct >= e) | (mean_ms >= r) | (F.coalesce(cpu, F.lit(0)) >= c) | (F.coalesce(mem, F.lit(0)) >= m)
        rule = (F.when if rule is None else rule.when)(cond, F.lit(name))
    return rule.otherwise(F.lit("normal"))


def cacheable(method: Column, status: Column, path: Column) -> Column:
    """GET 2xx, or POST 200 on search / validate / geocode / spatial paths."""
    post_ok = (method == "POST") & (status == 200) & (
        path.contains("/search") | path.contains("/validate") | path.contains("/geocode") | path.contains("/spatial"))
    return ((method == "GET") & (status >= 200) & (status < 300)) | post_ok
