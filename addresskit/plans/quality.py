"""Quality rules, quality aggregates and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import quality as Q
from . import common as C
from .registry import query

O = C.O_STAGED
_IN_BOX = "(latitude BETWEEN -45 AND -10 AND longitude BETWEEN 110 AND 155)"
_PCT = "CAST({n} AS DOUBLE) / count(*) * 100"


def _issue_sql(where: str, rule: str, type_: str, msg: str, sev: str, comp: str | None) -> str:
    comp_sql = f"'{comp}'" if comp else "CAST(NULL AS VARCHAR)"
    return (
        f"SELECT address_detail_pid, '{rule}' AS rule, '{type_}' AS type, {msg} AS message, "
        f"'{sev}' AS severity, {comp_sql} AS component FROM staged WHERE {where}"
    )


def _rule_query(name, fn, *parts, oracle=None):
    @query(name, oracle or O + "\nUNION ALL\n".join(parts))
    def q(spark, sf):
        s = C.staged(spark, sf)
        if name == "rule_components":
            s = Q.with_postcode_check(s, spark)
        return Q.issue_rows(s, "address_detail_pid", fn(s))

    q.__doc__ = fn.__doc__
    return q


_rule_query(
    "rule_required", Q.rule_required,
    _issue_sql("locality_name IS NULL", "required", "MISSING_COMPONENT", "'Locality name is required'", "ERROR",
               "locality"),
    _issue_sql("street_name IS NULL AND building_name IS NULL", "required", "MISSING_COMPONENT",
               "'Street name or building name is required for addressing'", "ERROR", "street"),
)
_rule_query(
    "rule_bounds", Q.rule_bounds,
    _issue_sql(f"NOT {_IN_BOX}", "bounds", "INVALID_FORMAT",
               "printf('Coordinates (%.6f, %.6f) are outside Australian boundaries', latitude, longitude)",
               "ERROR", None),
)
_rule_query(
    "rule_postcode", Q.rule_postcode,
    _issue_sql("postcode IS NULL", "postcode", "MISSING_COMPONENT", "'Postcode is missing'", "WARNING", "postcode"),
    _issue_sql("postcode IS NOT NULL AND (TRY_CAST(postcode AS INTEGER) IS NULL OR TRY_CAST(postcode AS INTEGER) < 100 "
               "OR TRY_CAST(postcode AS INTEGER) > 9999)", "postcode", "INVALID_FORMAT", "'Invalid postcode format'",
               "ERROR", "postcode"),
)
_rule_query(
    "rule_length", Q.rule_length,
    _issue_sql("length(formatted_address) < 10", "length", "INVALID_FORMAT",
               "'Address appears to be too short or incomplete'", "WARNING", None),
    _issue_sql("length(formatted_address) > 500", "length", "INVALID_FORMAT", "'Address exceeds maximum length'",
               "WARNING", None),
)

_PC_RANGES = ", ".join(f"('{s}', {lo}, {hi})" for s, lo, hi in Q.POSTCODE_RANGES)
O_PC = f""",
ranges AS (SELECT * FROM (VALUES {_PC_RANGES}) AS r(range_state, lo, hi)),
staged_pc AS (
  SELECT s.*, EXISTS (SELECT 1 FROM ranges r WHERE r.range_state = s.state_code
                      AND TRY_CAST(s.postcode AS INTEGER) BETWEEN r.lo AND r.hi) AS postcode_state_valid
  FROM staged s
)
"""
def _components_sql() -> str:
    def part(where, msg, type_, comp):
        return (
            f"SELECT address_detail_pid, 'components' AS rule, '{type_}' AS type, '{msg}' AS message, "
            f"'ERROR' AS severity, '{comp}' AS component FROM staged_pc WHERE {where}"
        )

    return O + O_PC + "\nUNION ALL\n".join([
        part("street_name IS NULL", "Missing street name", "MISSING_COMPONENT", "street"),
        part("locality_name IS NULL", "Missing locality name", "MISSING_COMPONENT", "locality"),
        part("postcode IS NULL", "Missing postcode", "MISSING_COMPONENT", "postcode"),
        part("postcode IS NOT NULL AND NOT postcode_state_valid", "Invalid postcode for state", "INVALID_FORMAT",
             "postcode"),
    ])


_rule_query("rule_components", Q.rule_components, oracle=_components_sql())


@query(
    "postcode_state_valid",
    O + O_PC + "SELECT address_detail_pid, state_code, postcode, postcode_state_valid FROM staged_pc",
)
def postcode_state_valid(spark, sf):
    """F8: postcode inside one of its state's ranges (broadcast range join)."""
    s = C.staged(spark, sf).select("address_detail_pid", "state_code", "postcode")
    return Q.with_postcode_check(s, spark)


@query(
    "validation_issues",
    O
    + """,
iss AS (
  SELECT address_detail_pid, 'ERROR' AS severity FROM staged WHERE locality_name IS NULL
  UNION ALL SELECT address_detail_pid, 'ERROR' FROM staged WHERE street_name IS NULL AND building_name IS NULL
  UNION ALL SELECT address_detail_pid, 'ERROR' FROM staged
    WHERE NOT (latitude BETWEEN -45 AND -10 AND longitude BETWEEN 110 AND 155)
  UNION ALL SELECT address_detail_pid, 'WARNING' FROM staged WHERE postcode IS NULL
  UNION ALL SELECT address_detail_pid, 'ERROR' FROM staged
    WHERE postcode IS NOT NULL AND (TRY_CAST(postcode AS INTEGER) IS NULL
          OR TRY_CAST(postcode AS INTEGER) < 100 OR TRY_CAST(postcode AS INTEGER) > 9999)
  UNION ALL SELECT address_detail_pid, 'WARNING' FROM staged WHERE length(formatted_address) < 10
  UNION ALL SELECT address_detail_pid, 'WARNING' FROM staged WHERE length(formatted_address) > 500
)
SELECT s.address_detail_pid,
       count(i.severity) AS n_issues,
       count(i.severity) FILTER (WHERE i.severity = 'ERROR') AS n_errors,
       count(i.severity) FILTER (WHERE i.severity = 'WARNING') AS n_warnings,
       CASE WHEN count(i.severity) FILTER (WHERE i.severity = 'ERROR') > 0 THEN 'INVALID'
            WHEN count(i.severity) > 0 THEN 'PARTIAL' ELSE 'VALID' END AS status
FROM staged s LEFT JOIN iss i ON i.address_detail_pid = s.address_detail_pid
GROUP BY s.address_detail_pid
""",
)
def validation_issues(spark, sf):
    """Q7: all rules per record, issue counts and the VALID / PARTIAL / INVALID roll-up."""
    s = Q.with_issues(C.staged(spark, sf))
    sev = F.col("issues.severity")
    return s.select(
        "address_detail_pid",
        F.size("issues").cast("long").alias("n_issues"),
        F.size(F.filter(sev, lambda x: x == "ERROR")).cast("long").alias("n_errors"),
        F.size(F.filter(sev, lambda x: x == "WARNING")).cast("long").alias("n_warnings"),
        F.col("rule_status").alias("status"),
    )


@query(
    "integrity_stats",
    O
    + """
SELECT count(*) AS total_records,
       count(*) FILTER (WHERE validation_status = 'VALID') AS valid_records,
       count(*) FILTER (WHERE validation_status = 'INVALID') AS invalid_records,
       count(*) FILTER (WHERE validation_status = 'PARTIAL') AS warning_records,
       round(avg(confidence_score), 4) AS avg_confidence,
       round(avg(completeness_score), 4) AS avg_completeness
FROM validated
""",
)
def integrity_stats(spark, sf):
    """A2: counts by validation status and averages (optionally one import batch)."""
    return _integrity(C.validated(spark, sf))


def _integrity(v):
    s = F.col("validation_status")
    return v.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if(s == "VALID").alias("valid_records"),
        F.count_if(s == "INVALID").alias("invalid_records"),
        F.count_if(s == "PARTIAL").alias("warning_records"),
        F.round(F.avg("confidence_score"), 4).alias("avg_confidence"),
        F.round(F.avg("completeness_score"), 4).alias("avg_completeness"),
    )


def _completeness_frame(spark, sf):
    a = C.addresses(spark, sf).select("locality_pid", "street_name", "number_first", "building_name",
                                      "completeness_score")
    loc = C.localities(spark, sf).select("locality_pid", F.col("postcode").alias("locality_postcode"))
    j = a.join(loc, "locality_pid", "left")
    n = F.count(F.lit(1))

    def pct(c):
        return F.count(c).cast("double") / n * 100

    return j.agg(
        n.alias("total"),
        pct("street_name").alias("street_name_present"),
        pct("number_first").alias("house_number_present"),
        pct("locality_postcode").alias("postcode_present"),
        pct("building_name").alias("building_name_present"),
        F.coalesce(F.avg("completeness_score"), F.lit(0.0)).alias("average_completeness"),
        F.count_if(F.col("completeness_score") >= 80).alias("high_quality_addresses"),
    )


O_COMPLETENESS = """,
completeness AS (
  SELECT count(*) AS total,
         CAST(count(a.street_name) AS DOUBLE) / count(*) * 100 AS street_name_present,
         CAST(count(a.number_first) AS DOUBLE) / count(*) * 100 AS house_number_present,
         CAST(count(l.postcode) AS DOUBLE) / count(*) * 100 AS postcode_present,
         CAST(count(a.building_name) AS DOUBLE) / count(*) * 100 AS building_name_present,
         coalesce(avg(a.completeness_score), 0) AS average_completeness,
         count(*) FILTER (WHERE a.completeness_score >= 80) AS high_quality_addresses
  FROM addresses a LEFT JOIN localities l ON l.locality_pid = a.locality_pid
)
"""


@query(
    "completeness_metrics",
    O + O_COMPLETENESS
    + """SELECT total, round(street_name_present, 4) AS street_name_present,
       round(house_number_present, 4) AS house_number_present, round(postcode_present, 4) AS postcode_present,
       round(building_name_present, 4) AS building_name_present,
       round(average_completeness, 4) AS average_completeness, high_quality_addresses FROM completeness""",
)
def completeness_metrics(spark, sf):
    """A3: share of addresses with street, number, postcode, building; mean completeness."""
    m = _completeness_frame(spark, sf)
    return m.select(
        "total",
        *[F.round(c, 4).alias(c) for c in ("street_name_present", "house_number_present", "postcode_present",
                                           "building_name_present", "average_completeness")],
        "high_quality_addresses",
    )


def _coordinate_frame(spark, sf):
    a = C.addresses(spark, sf)
    lat, lon = F.col("latitude"), F.col("longitude")
    w = {"PROPERTY": 4, "STREET": 3, "LOCALITY": 2, "REGION": 1}
    p = F.col("coordinate_precision")
    return a.agg(
        F.count(F.lit(1)).alias("total_coordinates"),
        F.count_if(G.in_bounds(lat, lon, "quality")).alias("valid_coordinates"),
        F.count_if((lat < -45.0) | (lat > -10.0) | (lon < 110.0) | (lon > 155.0)).alias("out_of_bounds_count"),
        *[F.count_if(p == k).alias(f"n_{k.lower()}") for k in w],
    ).withColumn(
        "average_precision_score",
        F.when(
            F.col("total_coordinates") > 0,
            sum(F.col(f"n_{k.lower()}") * v for k, v in w.items()).cast("double")
            / (sum(F.col(f"n_{k.lower()}") for k in w)) / 4 * 100,
        ).otherwise(F.lit(0.0)),
    )


O_COORDS = f""",
coords AS (
  SELECT count(*) AS total_coordinates,
         count(*) FILTER (WHERE {_IN_BOX}) AS valid_coordinates,
         count(*) FILTER (WHERE latitude < -45 OR latitude > -10 OR longitude < 110 OR longitude > 155)
           AS out_of_bounds_count,
         count(*) FILTER (WHERE coordinate_precision = 'PROPERTY') AS n_property,
         count(*) FILTER (WHERE coordinate_precision = 'STREET') AS n_street,
         count(*) FILTER (WHERE coordinate_precision = 'LOCALITY') AS n_locality,
         count(*) FILTER (WHERE coordinate_precision = 'REGION') AS n_region
  FROM addresses
),
coords2 AS (
  SELECT *, CASE WHEN total_coordinates > 0
                 THEN CAST(4 * n_property + 3 * n_street + 2 * n_locality + n_region AS DOUBLE)
                      / (n_property + n_street + n_locality + n_region) / 4 * 100
                 ELSE 0 END AS average_precision_score
  FROM coords
)
"""


@query(
    "coordinate_stats",
    O + O_COORDS + "SELECT total_coordinates, valid_coordinates, out_of_bounds_count FROM coords2",
)
def coordinate_stats(spark, sf):
    """A4: total, inside the quality box, outside it."""
    return _coordinate_frame(spark, sf).select("total_coordinates", "valid_coordinates", "out_of_bounds_count")


@query(
    "precision_distribution",
    O
    + """
SELECT lv.coordinate_precision, CAST(coalesce(c.n, 0) AS BIGINT) AS address_count
FROM (VALUES ('PROPERTY'), ('STREET'), ('LOCALITY'), ('REGION')) AS lv(coordinate_precision)
LEFT JOIN (SELECT coordinate_precision, count(*) AS n FROM addresses GROUP BY 1) c
  ON c.coordinate_precision = lv.coordinate_precision
""",
)
def precision_distribution(spark, sf):
    """A5: address count per precision level, zero-filled over the four levels."""
    levels = spark.createDataFrame([(x,) for x in ("PROPERTY", "STREET", "LOCALITY", "REGION")],
                                   "coordinate_precision string")
    counts = C.addresses(spark, sf).groupBy("coordinate_precision").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(levels).join(counts, "coordinate_precision", "left").select(
        "coordinate_precision", F.coalesce("n", F.lit(0)).cast("long").alias("address_count")
    )


@query("precision_score", O + O_COORDS + "SELECT round(average_precision_score, 4) AS average_precision_score FROM coords2")
def precision_score(spark, sf):
    """Weighted 4/3/2/1 mean / 4 x 100."""
    return _coordinate_frame(spark, sf).select(F.round("average_precision_score", 4).alias("average_precision_score"))


@query(
    "issues_summary",
    O
    + """
SELECT count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM streets s
                                          WHERE s.street_locality_pid = a.street_locality_pid)) AS missing_street,
       count(*) FILTER (WHERE number_first IS NULL) AS missing_house_number,
       count(*) FILTER (WHERE building_name IS NULL AND flat_number IS NULL AND number_first IS NULL)
         AS insufficient_addressing,
       count(*) FILTER (WHERE latitude < -45 OR latitude > -10 OR longitude < 110 OR longitude > 155)
         AS invalid_coordinates,
       count(*) FILTER (WHERE confidence_score < 50) AS low_confidence
FROM addresses a
""",
)
def issues_summary(spark, sf):
    """A7 + J8: five issue counts; missing street is an anti-join (null key counts as missing)."""
    a = C.addresses(spark, sf)
    keys = C.streets(spark, sf).select("street_locality_pid").distinct().withColumn("_hit", F.lit(True))
    j = a.join(keys, "street_locality_pid", "left")
    lat, lon = F.col("latitude"), F.col("longitude")
    return j.agg(
        F.count_if(F.col("_hit").isNull()).alias("missing_street"),
        F.count_if(F.col("number_first").isNull()).alias("missing_house_number"),
        F.count_if(F.col("building_name").isNull() & F.col("flat_number").isNull()
                   & F.col("number_first").isNull()).alias("insufficient_addressing"),
        F.count_if((lat < -45.0) | (lat > -10.0) | (lon < 110.0) | (lon > 155.0)).alias("invalid_coordinates"),
        F.count_if(F.col("confidence_score") < 50).alias("low_confidence"),
    )


def _quality_frame(spark, sf):
    v = C.validated(spark, sf).agg(
        F.avg("confidence_score").alias("avg_confidence"), F.avg("completeness_score").alias("avg_completeness")
    )
    co = _coordinate_frame(spark, sf)
    cm = _completeness_frame(spark, sf)
    m = v.crossJoin(co).crossJoin(cm)  # three 1-row aggregates
    validity = F.when(F.col("total_coordinates") > 0,
                      F.col("valid_coordinates").cast("double") / F.col("total_coordinates") * 100).otherwise(0.0)
    score = (
        F.coalesce("avg_confidence", F.lit(0.0)) * 0.3
        + F.coalesce("avg_completeness", F.lit(0.0)) * 0.3
        + validity * 0.2
        + F.col("average_precision_score") * 0.2
    )
    return m.withColumn("quality_score", G.round_half_up(score, 2))


O_QUALITY = O_COMPLETENESS + O_COORDS + """,
qavg AS (SELECT avg(confidence_score) AS avg_confidence, avg(completeness_score) AS avg_completeness FROM validated),
quality AS (
  SELECT *, floor((coalesce(avg_confidence, 0) * 0.3 + coalesce(avg_completeness, 0) * 0.3
          + CASE WHEN total_coordinates > 0 THEN CAST(valid_coordinates AS DOUBLE) / total_coordinates * 100 ELSE 0 END * 0.2
          + average_precision_score * 0.2) * 100 + 0.5) / 100 AS quality_score
  FROM qavg, coords2, completeness
)
"""


@query("quality_score", O + O_QUALITY + "SELECT quality_score FROM quality")
def quality_score(spark, sf):
    """0.3 confidence + 0.3 completeness + 0.2 valid share + 0.2 precision, 2 dp."""
    return _quality_frame(spark, sf).select("quality_score")


_REC_DEFAULT = "Data quality meets acceptable standards. Continue monitoring for quality degradation."


@query(
    "quality_recommendations",
    O + O_QUALITY
    + f""",
recs AS (
  SELECT 1 AS k, 'Overall data quality is below acceptable threshold (70%). Consider data cleansing.' AS message
    FROM quality WHERE quality_score < 70
  UNION ALL SELECT 2, printf('%.1f', 100 - street_name_present) || '% of addresses missing street names. Review source data quality.'
    FROM quality WHERE street_name_present < 95
  UNION ALL SELECT 3, printf('%.1f', 100 - house_number_present) || '% of addresses missing house numbers. This affects addressability.'
    FROM quality WHERE house_number_present < 80
  UNION ALL SELECT 4, printf('%.1f', 100 - postcode_present) || '% of addresses missing postcodes. Essential for delivery addressing.'
    FROM quality WHERE postcode_present < 98
  UNION ALL SELECT 5, CAST(out_of_bounds_count AS VARCHAR) || ' addresses have coordinates outside Australian boundaries. Review coordinate data.'
    FROM quality WHERE out_of_bounds_count > 0
  UNION ALL SELECT 6, 'Average coordinate precision is ' || printf('%.1f', average_precision_score) || '%. Consider improving geocoding accuracy.'
    FROM quality WHERE average_precision_score < 60
  UNION ALL SELECT 7, 'Less than 70% of addresses meet high quality standards. Implement data enrichment processes.'
    FROM quality WHERE CAST(high_quality_addresses AS DOUBLE) / total * 100 < 70
),
recs2 AS (
  SELECT k, message FROM recs
  UNION ALL SELECT 8, '{_REC_DEFAULT}' WHERE NOT EXISTS (SELECT 1 FROM recs)
)
SELECT CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS seq, message FROM recs2
""",
)
def quality_recommendations(spark, sf):
    """Threshold rules -> ordered messages; default message when none fires (D13 fixed)."""
    m = _quality_frame(spark, sf)
    c = F.col
    rules = [
        F.when(c("quality_score") < 70,
               F.lit("Overall data quality is below acceptable threshold (70%). Consider data cleansing.")),
        F.when(c("street_name_present") < 95, F.concat(F.format_string("%.1f", 100 - c("street_name_present")),
               F.lit("% of addresses missing street names. Review source data quality."))),
        F.when(c("house_number_present") < 80, F.concat(F.format_string("%.1f", 100 - c("house_number_present")),
               F.lit("% of addresses missing house numbers. This affects addressability."))),
        F.when(c("postcode_present") < 98, F.concat(F.format_string("%.1f", 100 - c("postcode_present")),
               F.lit("% of addresses missing postcodes. Essential for delivery addressing."))),
        F.when(c("out_of_bounds_count") > 0, F.concat(c("out_of_bounds_count").cast("string"),
               F.lit(" addresses have coordinates outside Australian boundaries. Review coordinate data."))),
        F.when(c("average_precision_score") < 60, F.concat(
            F.lit("Average coordinate precision is "), F.format_string("%.1f", c("average_precision_score")),
            F.lit("%. Consider improving geocoding accuracy."))),
        F.when(c("high_quality_addresses").cast("double") / c("total") * 100 < 70,
               F.lit("Less than 70% of addresses meet high quality standards. Implement data enrichment processes.")),
    ]
    fired = F.filter(F.array(*rules), lambda x: x.isNotNull())
    msgs = F.when(F.size(fired) > 0, fired).otherwise(F.array(F.lit(_REC_DEFAULT)))
    return m.select(F.posexplode(msgs).alias("seq", "message")).select(F.col("seq").cast("long"), "message")


_REPORT_METRICS = [
    ("summary", "quality_score", "quality_score"),
    ("records", "total_records", "total_records"),
    ("records", "valid_records", "valid_records"),
    ("records", "invalid_records", "invalid_records"),
    ("records", "warning_records", "warning_records"),
    ("completeness", "street_name_present", "street_name_present"),
    ("completeness", "house_number_present", "house_number_present"),
    ("completeness", "postcode_present", "postcode_present"),
    ("completeness", "building_name_present", "building_name_present"),
    ("completeness", "average_completeness", "average_completeness"),
    ("completeness", "high_quality_addresses", "high_quality_addresses"),
    ("coordinates", "total_coordinates", "total_coordinates"),
    ("coordinates", "valid_coordinates", "valid_coordinates"),
    ("coordinates", "out_of_bounds_count", "out_of_bounds_count"),
    ("coordinates", "average_precision_score", "average_precision_score"),
    ("precision", "PROPERTY", "n_property"),
    ("precision", "STREET", "n_street"),
    ("precision", "LOCALITY", "n_locality"),
    ("precision", "REGION", "n_region"),
]


@query(
    "quality_report",
    O + O_QUALITY
    + """,
stats AS (
  SELECT count(*) AS total_records,
         count(*) FILTER (WHERE validation_status = 'VALID') AS valid_records,
         count(*) FILTER (WHERE validation_status = 'INVALID') AS invalid_records,
         count(*) FILTER (WHERE validation_status = 'PARTIAL') AS warning_records
  FROM validated
),
allm AS (SELECT * FROM quality, stats)
"""
    + "\nUNION ALL\n".join(
        f"SELECT '{s}' AS section, '{m}' AS metric, round(CAST({c} AS DOUBLE), 4) AS value FROM allm"
        for s, m, c in _REPORT_METRICS
    ),
)
def quality_report(spark, sf):
    """A10: the quality report as a long (section, metric, value) table."""
    q = _quality_frame(spark, sf).crossJoin(_integrity(C.validated(spark, sf)).drop("avg_confidence",
                                                                                     "avg_completeness"))
    stack = ", ".join(f"'{s}', '{m}', CAST({c} AS DOUBLE)" for s, m, c in _REPORT_METRICS)
    long = q.selectExpr(f"stack({len(_REPORT_METRICS)}, {stack}) AS (section, metric, value)")
    return long.select("section", "metric", F.round("value", 4).alias("value"))


@query(
    "fk_violations",
    O
    + """
SELECT 'addresses.street_locality_pid' AS constraint_name, a.address_detail_pid AS child_key,
       a.street_locality_pid AS parent_key
FROM addresses a WHERE a.street_locality_pid IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM streets s WHERE s.street_locality_pid = a.street_locality_pid)
UNION ALL
SELECT 'addresses.locality_pid', a.address_detail_pid, a.locality_pid
FROM addresses a WHERE NOT EXISTS (SELECT 1 FROM localities l WHERE l.locality_pid = a.locality_pid)
UNION ALL
SELECT 'streets.locality_pid', s.street_locality_pid, s.locality_pid
FROM streets s WHERE NOT EXISTS (SELECT 1 FROM localities l WHERE l.locality_pid = s.locality_pid)
UNION ALL
SELECT 'localities.state_code', l.locality_pid, l.state_code
FROM localities l WHERE l.state_code NOT IN ('NSW','VIC','QLD','SA','WA','TAS','NT','ACT','OT')
""",
)
def fk_violations(spark, sf):
    """One anti join per foreign key of the schema, unioned."""
    from ..operators.register import dim_states

    a, s, loc = C.addresses(spark, sf), C.streets(spark, sf), C.localities(spark, sf)
    st = dim_states(spark)

    def anti(child, child_key, fk, parent, parent_key, name):
        c = child.filter(F.col(fk).isNotNull()).select(F.col(child_key).alias("child_key"), F.col(fk).alias("parent_key"))
        p = parent.select(F.col(parent_key).alias("parent_key"))
        return c.join(p, "parent_key", "left_anti").select(F.lit(name).alias("constraint_name"), "child_key",
                                                           "parent_key")

    return (
        anti(a, "address_detail_pid", "street_locality_pid", s, "street_locality_pid", "addresses.street_locality_pid")
        .unionByName(anti(a, "address_detail_pid", "locality_pid", loc, "locality_pid", "addresses.locality_pid"))
        .unionByName(anti(s, "street_locality_pid", "locality_pid", loc, "locality_pid", "streets.locality_pid"))
        .unionByName(anti(loc, "locality_pid", "state_code", F.broadcast(st), "state_code", "localities.state_code"))
    )


@query(
    "duplicate_addresses",
    O
    + """
SELECT 'primary_key' AS check_name, address_detail_pid AS dup_key, count(*) AS copies,
       min(address_detail_pid) AS keep_pid
FROM addresses GROUP BY address_detail_pid HAVING count(*) > 1
UNION ALL
SELECT 'gnaf_pid', gnaf_pid, count(*), min(address_detail_pid)
FROM addresses GROUP BY gnaf_pid HAVING count(*) > 1
UNION ALL
SELECT 'same_address', lower(formatted_address), count(*), min(address_detail_pid)
FROM addresses GROUP BY lower(formatted_address) HAVING count(*) > 1
""",
)
def duplicate_addresses(spark, sf):
    """Key uniqueness and same-text duplicates; one row per duplicate group.

    Groups are counted, never collected, so a hot key costs one partial
    aggregate per task rather than one oversized group.
    """
    a = C.addresses(spark, sf).select("address_detail_pid", "gnaf_pid", "formatted_address")

    def dups(key, name):
        return (
            a.groupBy(key.alias("dup_key"))
            .agg(F.count(F.lit(1)).alias("copies"), F.min("address_detail_pid").alias("keep_pid"))
            .filter(F.col("copies") > 1)
            .select(F.lit(name).alias("check_name"), "dup_key", "copies", "keep_pid")
        )

    return (
        dups(F.col("address_detail_pid"), "primary_key")
        .unionByName(dups(F.col("gnaf_pid"), "gnaf_pid"))
        .unionByName(dups(F.lower("formatted_address"), "same_address"))
    )
