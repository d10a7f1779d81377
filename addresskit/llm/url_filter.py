"""URL filters (SQL functions only): listed canonical URLs behind a blocked Bloom filter, and host / path rules.

Every page URL's canonical hash is tested against a fixed-size blocked Bloom filter of the list. Pages that it lets
pass as possible hits go to an exact hash join with the list, which removes false positives; the others skip the join.

Edge cases: a null URL, or one without ``://``, has empty host and path, matches no rule and is listed nowhere; an
empty list blocks nothing; repeated pages each get their row; other columns of the pages pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom_filter, filter_words, maybe_listed

# The rules (host, path, verdict), and the host labels whose pages make up the query's list.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LISTED_LABELS = r"^(?:(?:www|m|blog)\.)?(?:casino|free|cheap|ads)-"
SALTS = 8


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: the host A-Z lower-cased; both empty for null or without ``://``."""
    has = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    rest = F.substr(url, F.locate("://", url) + 3)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, low).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.`` and path without trailing slashes; null for an empty host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, "/+$", "")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does. A rule fits its host and all subdomains."""
    name = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def with_canonical(pages: DataFrame) -> DataFrame:
    """Pages with ``url_host``, ``url_path``, ``url_key`` (canonical URL) and its hash ``url_hash``."""
    host, path = url_parts(F.col("url"))
    return (pages.withColumn("url_host", host).withColumn("url_path", path)
            .withColumn("url_key", canonical(F.col("url_host"), F.col("url_path")))
            .withColumn("url_hash", F.xxhash64("url_key")))


def mark_listed(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """``with_canonical`` pages plus boolean ``url_listed``: whether ``listed`` (column url_key) has the page's URL."""
    keys = listed.where(F.col("url_key").isNotNull()).select("url_key").distinct()
    words = filter_words(keys.count())
    bloom = bloom_filter(keys.select(F.xxhash64("url_key").alias("h")), "h", words).scalar()
    tested = pages.withColumn("_bloom", bloom)
    tested = tested.withColumn("_maybe", F.col("url_key").isNotNull() & F.expr(maybe_listed("url_hash", "_bloom", words))).drop("_bloom")
    spread = keys.select("url_key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias("_hit"))
    hits = (tested.where("_maybe").withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
            .join(spread.hint("shuffle_hash"), ["url_key", "_salt"], "left")
            .withColumn("url_listed", F.coalesce("_hit", F.lit(False))).drop("_salt", "_hit", "_maybe"))
    rest = tested.where(~F.col("_maybe")).withColumn("url_listed", F.lit(False)).drop("_maybe")
    return rest.unionByName(hits)


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; without a rule, pages on the list are blocked."""
    pages = with_canonical(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    listed = pages.where(F.col("url_host").rlike(LISTED_LABELS)).select("url_key")
    judged = mark_listed(pages, listed)
    rule, verdict = rule_of(F.col("url_host"), F.col("url_path"))
    return judged.select(
        "page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("url_listed"), "block").otherwise("allow")).alias("verdict"),
        F.col("url_listed").alias("listed"),
    )


ORACLE = r"""
WITH parts AS (
  SELECT page_id, coalesce(position('://' IN url) > 0, false) AS has, substr(url, position('://' IN url) + 3) AS rest FROM pages
), split AS (
  SELECT page_id, CASE WHEN has THEN translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN has THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM parts
), keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') END AS url_key FROM split
), listed AS (
  SELECT DISTINCT url_key FROM keyed WHERE regexp_matches(host, '^(?:(?:www|m|blog)\.)?(?:casino|free|cheap|ads)-') AND url_key IS NOT NULL
), rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT k.*, (SELECT max_by({'r': h || p, 'v': v}, length(h || p)) FROM rules
               WHERE (k.host = h OR ends_with(k.host, '.' || h)) AND starts_with(k.path, p)) AS b,
         coalesce(k.url_key IN (SELECT url_key FROM listed), false) AS listed
  FROM keyed k
)
SELECT page_id, host, path, b.r AS rule, coalesce(b.v, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM best
"""
