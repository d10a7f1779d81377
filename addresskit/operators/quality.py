"""Data-quality rules (Q1-Q7), postcode range check (F8) and audits.

A rule is a function from an address DataFrame's columns to an
``array<struct<rule,type,message,severity,component>>`` column; the registry
below is the rule set. ``issues`` flattens the rule arrays, the issue table is
one ``explode`` away, and the status roll-up is an expression over the array:
no per-row Python anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G

ISSUE_FIELDS = ("rule", "type", "message", "severity", "component")

# Postcode ranges per state (inclusive).
POSTCODE_RANGES = [
    ("NSW", 1000, 1999), ("NSW", 2000, 2599), ("NSW", 2619, 2899), ("NSW", 2921, 2999),
    ("VIC", 3000, 3999), ("VIC", 8000, 8999),
    ("QLD", 4000, 4999), ("QLD", 9000, 9999),
    ("SA", 5000, 5799), ("SA", 5800, 5999),
    ("WA", 6000, 6797), ("WA", 6800, 6999),
    ("TAS", 7000, 7799), ("TAS", 7800, 7999),
    ("NT", 800, 899), ("NT", 900, 999),
    ("ACT", 200, 299), ("ACT", 2600, 2618), ("ACT", 2900, 2920),
]


def issue(cond: Column, rule: str, type_: str, message: Column | str, severity: str, component: str | None) -> Column:
    msg = message if isinstance(message, Column) else F.lit(message)
    return F.when(
        cond,
        F.struct(
            F.lit(rule).alias("rule"),
            F.lit(type_).alias("type"),
            msg.alias("message"),
            F.lit(severity).alias("severity"),
            F.lit(component).cast("string").alias("component"),
        ),
    )


def _issues(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def rule_required(df: DataFrame) -> Column:
    """Q1: locality required; street or building required."""
    return _issues(
        issue(F.col("locality_name").isNull(), "required", "MISSING_COMPONENT",
              "Locality name is required", "ERROR", "locality"),
        issue(F.col("street_name").isNull() & F.col("building_name").isNull(), "required", "MISSING_COMPONENT",
              "Street name or building name is required for addressing", "ERROR", "street"),
    )


def rule_bounds(df: DataFrame) -> Column:
    """Q2: coordinates inside the quality box."""
    lat, lon = F.col("latitude"), F.col("longitude")
    msg = F.format_string("Coordinates (%.6f, %.6f) are outside Australian boundaries", lat, lon)
    return _issues(issue(~G.in_bounds(lat, lon, "quality"), "bounds", "INVALID_FORMAT", msg, "ERROR", None))


def rule_postcode(df: DataFrame) -> Column:
    """Q3: missing postcode is a warning; non-numeric or outside 100..9999 is an error."""
    pc = F.col("postcode")
    n = pc.try_cast("int")
    return _issues(
        issue(pc.isNull(), "postcode", "MISSING_COMPONENT", "Postcode is missing", "WARNING", "postcode"),
        issue(pc.isNotNull() & (n.isNull() | (n < 100) | (n > 9999)), "postcode", "INVALID_FORMAT",
              "Invalid postcode format", "ERROR", "postcode"),
    )


def rule_length(df: DataFrame) -> Column:
    """Q4: address text shorter than 10 or longer than 500 characters."""
    n = F.length(F.col("formatted_address"))
    return _issues(
        issue(n < 10, "length", "INVALID_FORMAT", "Address appears to be too short or incomplete", "WARNING", None),
        issue(n > 500, "length", "INVALID_FORMAT", "Address exceeds maximum length", "WARNING", None),
    )


def rule_components(df: DataFrame) -> Column:
    """Q6: street, locality and postcode present; postcode valid for the state.

    Needs the boolean ``postcode_state_valid`` column from ``with_postcode_check``.
    """
    pc = F.col("postcode")
    return _issues(
        issue(F.col("street_name").isNull(), "components", "MISSING_COMPONENT", "Missing street name", "ERROR", "street"),
        issue(F.col("locality_name").isNull(), "components", "MISSING_COMPONENT", "Missing locality name", "ERROR",
              "locality"),
        issue(pc.isNull(), "components", "MISSING_COMPONENT", "Missing postcode", "ERROR", "postcode"),
        issue(pc.isNotNull() & ~F.col("postcode_state_valid"), "components", "INVALID_FORMAT",
              "Invalid postcode for state", "ERROR", "postcode"),
    )


# The rule set (pluggable: add a function returning an issue-array Column).
RULES: dict[str, Callable[[DataFrame], Column]] = {
    "required": rule_required,
    "bounds": rule_bounds,
    "postcode": rule_postcode,
    "length": rule_length,
}


def with_issues(df: DataFrame, rules: dict[str, Callable[[DataFrame], Column]] | None = None) -> DataFrame:
    """Q7: ``issues`` array from all rules and the VALID / PARTIAL / INVALID roll-up."""
    rules = rules or RULES
    arr = F.flatten(F.array(*[fn(df) for fn in rules.values()]))
    out = df.withColumn("issues", arr)
    sev = F.col("issues.severity")
    return out.withColumn(
        "rule_status",
        F.when(F.array_contains(sev, "ERROR"), F.lit("INVALID"))
        .when(F.size("issues") > 0, F.lit("PARTIAL"))
        .otherwise(F.lit("VALID")),
    )


def issue_rows(df: DataFrame, key: str, rule_col: Column) -> DataFrame:
    """Explode one rule's issue array into rows keyed by ``key``."""
    return df.select(F.col(key), F.explode(rule_col).alias("i")).select(key, *[f"i.{f}" for f in ISSUE_FIELDS])


def postcode_ranges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POSTCODE_RANGES, "range_state string, lo int, hi int")


def with_postcode_check(df: DataFrame, spark: SparkSession, state: str = "state_code",
                        postcode: str = "postcode") -> DataFrame:
    """F8: range join against the 19-row range table (broadcast: fixed, proven size).

    Ranges of one state do not overlap, so the left join yields at most one
    match per row and no de-duplication is needed.
    """
    r = F.broadcast(postcode_ranges(spark))
    code = F.col(postcode).try_cast("int")
    j = df.join(r, (F.col(state) == r.range_state) & code.between(r.lo, r.hi), "left")
    return j.withColumn("postcode_state_valid", F.col("lo").isNotNull()).drop("range_state", "lo", "hi")
