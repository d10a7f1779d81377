"""Statistical-area, LGA and delivery-office code functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First digit of an ABS statistical-area code -> state.
SA_STATE_DIGIT = {"1": "NSW", "2": "VIC", "3": "QLD", "4": "SA", "5": "WA", "6": "TAS", "7": "NT", "8": "ACT"}

# LGA category keywords, checked in this order (default Council).
LGA_CATEGORIES = [
    ("city", "City"),
    ("shire", "Shire"),
    ("town", "Town"),
    ("borough", "Borough"),
    ("district", "District"),
    ("council", "Council"),
    ("regional", "Regional"),
]

# Postcode ranges -> delivery office (else Unknown).
DELIVERY_OFFICES = [
    (1000, 2999, "NSW"),
    (3000, 3999, "VIC"),
    (4000, 4999, "QLD"),
    (5000, 5999, "SA"),
    (6000, 6999, "WA"),
    (7000, 7999, "TAS"),
    (800, 899, "NT"),
    (200, 299, "ACT"),
]


def _known(code: Column) -> Column:
    return code.isNotNull() & (code != "") & (code != "Unknown")


def sa3_from_sa2(sa2: Column) -> Column:
    """First 5 characters of SA2; shorter codes pass through; missing -> Unknown."""
    return F.when(~_known(sa2), F.lit("Unknown")).when(F.length(sa2) >= 5, F.substring(sa2, 1, 5)).otherwise(sa2)


def sa4_from_sa2(sa2: Column) -> Column:
    """First 3 characters of SA2."""
    return F.when(~_known(sa2), F.lit("Unknown")).when(F.length(sa2) >= 3, F.substring(sa2, 1, 3)).otherwise(sa2)


def ccd_from_mesh_block(mb: Column) -> Column:
    """First 8 characters of the mesh block code; missing -> null."""
    return F.when(mb.isNull() | (mb == ""), F.lit(None).cast("string")).when(
        F.length(mb) >= 8, F.substring(mb, 1, 8)).otherwise(mb)


def state_from_sa_code(code: Column) -> Column:
    """First digit 1-8 -> state, else AUS; missing -> Unknown."""
    m = F.create_map(*[F.lit(x) for kv in SA_STATE_DIGIT.items() for x in kv])
    return F.when(~_known(code), F.lit("Unknown")).otherwise(F.coalesce(m[F.substring(code, 1, 1)], F.lit("AUS")))


def sa_name(code: Column, level: str) -> Column:
    """SA1/SA2 '<level> <code>', SA3/SA4 '<state> <level> <code>', missing -> 'Unknown <level>'."""
    if level in ("SA1", "SA2"):
        named = F.concat(F.lit(f"{level} "), code)
    else:
        named = F.concat(state_from_sa_code(code), F.lit(f" {level} "), code)
    return F.when(~_known(code), F.lit(f"Unknown {level}")).otherwise(named)


def lga_category(name: Column) -> Column:
    """First matching keyword (D15: 'Regional Council' -> Council)."""
    n = F.lower(name)
    rule = None
    for kw, cat in LGA_CATEGORIES:
        rule = (F.when if rule is None else rule.when)(n.contains(kw), F.lit(cat))
    return rule.otherwise(F.lit("Council"))


def delivery_office(postcode: Column) -> Column:
    """Numeric postcode ranges, else Unknown (D15: 2600-2618 -> NSW, 8xxx -> Unknown)."""
    n = postcode.try_cast("int")
    rule = None
    for lo, hi, office in DELIVERY_OFFICES:
        rule = (F.when if rule is None else rule.when)(n.between(lo, hi), F.lit(office))
    return rule.otherwise(F.lit("Unknown"))
