"""Column functions for address records (load and parser variants).

All functions take and return ``Column`` objects built from
``pyspark.sql.functions`` so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# State PID -> abbreviation used by the dataset load.
STATE_BY_PID = {
    "1": "NSW",
    "2": "VIC",
    "3": "QLD",
    "4": "SA",
    "5": "WA",
    "6": "TAS",
    "7": "NT",
    "8": "ACT",
    "9": "OT",
}

# State code -> state name (seed rows plus the added OT row).
STATE_NAMES = [
    ("NSW", "New South Wales"),
    ("VIC", "Victoria"),
    ("QLD", "Queensland"),
    ("SA", "South Australia"),
    ("WA", "Western Australia"),
    ("TAS", "Tasmania"),
    ("NT", "Northern Territory"),
    ("ACT", "Australian Capital Territory"),
    ("OT", "Other Territories"),
]

# Parser-variant abbreviation map (upper-cased input -> code).
STATE_BY_ABBREVIATION = {
    "NSW": "NSW",
    "VIC": "VIC",
    "QLD": "QLD",
    "SA": "SA",
    "WA": "WA",
    "TAS": "TAS",
    "NT": "NT",
    "ACT": "ACT",
}

COMPLETENESS_FIELDS = (
    "street_name",
    "number_first",
    "postcode",
    "street_type",
    "building_name",
    "flat_number",
    "lot_number",
    "legal_parcel_id",
    "geocode_type",
    "reliability",
)


def _lit_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def blank_to_null(c: Column | str) -> Column:
    """Empty (after trim) text is missing, as in JavaScript truthiness."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(c), F.lit(""))


def state_from_pid(pid: Column) -> Column:
    """P10 load variant: PID 1..9 -> code, anything else -> NSW."""
    return F.coalesce(_lit_map(STATE_BY_PID)[pid], F.lit("NSW"))


def state_from_abbreviation(abbr: Column) -> Column:
    """P10 parser variant: known abbreviation, else NSW."""
    return F.coalesce(_lit_map(STATE_BY_ABBREVIATION)[F.upper(abbr)], F.lit("NSW"))


def precision_from_type(geocode_type: Column, variant: str = "load") -> Column:
    """PROPERTY / STREET / LOCALITY / REGION by substring, missing -> LOCALITY."""
    t = F.upper(geocode_type)
    rule = F.when(t.isNull(), F.lit("LOCALITY"))
    if variant == "parser":
        rule = rule.when(t.contains("BUILDING"), F.lit("PROPERTY"))
    return (
        rule.when(t.contains("PROPERTY"), F.lit("PROPERTY"))
        .when(t.contains("STREET"), F.lit("STREET"))
        .when(t.contains("LOCALITY"), F.lit("LOCALITY"))
        .otherwise(F.lit("REGION"))
    )


def reliability_load(r: Column) -> Column:
    """P12 load variant: ``parseInt(x) || 2`` (no range check; 0 and junk -> 2)."""
    v = r.try_cast("int")
    return F.when(v.isNull() | (v == 0), F.lit(2)).otherwise(v)


def reliability_parser(r: Column) -> Column:
    """P12 parser variant: 1, 2, 3 kept, else 2."""
    v = r.try_cast("int")
    return F.when(v.isin(1, 2, 3), v).otherwise(F.lit(2))


def status_from_text(s: Column) -> Column:
    """RETIRED / PROPOSED by substring, else CURRENT."""
    u = F.upper(s)
    return (
        F.when(u.contains("RETIRED"), F.lit("RETIRED"))
        .when(u.contains("PROPOSED"), F.lit("PROPOSED"))
        .otherwise(F.lit("CURRENT"))
    )


def locality_class_from_name(name: Column) -> Column:
    """Name contains city -> C, town -> T, else S."""
    n = F.lower(name)
    return F.when(n.contains("city"), F.lit("C")).when(n.contains("town"), F.lit("T")).otherwise(F.lit("S"))


def confidence_load(street_name: Column, number_first: Column, postcode: Column) -> Column:
    """P7 load variant: 100 -20 no street -15 no number -10 no postcode, floor 0."""
    score = (
        F.lit(100)
        - F.when(street_name.isNull(), 20).otherwise(0)
        - F.when(number_first.isNull(), 15).otherwise(0)
        - F.when(postcode.isNull(), 10).otherwise(0)
    )
    return F.greatest(score, F.lit(0))


def confidence_parser(street_name: Column, number_first: Column, postcode: Column, street_type: Column) -> Column:
    """P7 parser variant: the load rule plus -5 without a street type."""
    return F.greatest(
        confidence_load(street_name, number_first, postcode) - F.when(street_type.isNull(), 5).otherwise(0),
        F.lit(0),
    )


def completeness(*present: Column) -> Column:
    """Share of named fields present, x100, rounded (half up)."""
    n = len(present)
    hits = sum((c.isNotNull().cast("int") for c in present), F.lit(0))
    return F.floor(hits * F.lit(100.0) / F.lit(n) + F.lit(0.5)).cast("int")


def flat_part(flat_type: Column, flat_number: Column) -> Column:
    return F.when(flat_type.isNotNull() & flat_number.isNotNull(), F.concat_ws(" ", flat_type, flat_number))


def street_part(street_name: Column, street_type: Column, street_suffix: Column | None = None) -> Column:
    parts = [street_name, street_type] + ([street_suffix] if street_suffix is not None else [])
    return F.when(street_name.isNotNull(), F.concat_ws(" ", *parts))


def locality_part(locality_name: Column, state: Column, postcode: Column) -> Column:
    return F.when(locality_name.isNotNull(), F.concat_ws(" ", locality_name, state, postcode))


def address_line(flat_type, flat_number, building, number, street_name, street_type) -> Column:
    """Formatted address without its locality part."""
    return F.concat_ws(
        ", ", flat_part(flat_type, flat_number), building, number, street_part(street_name, street_type)
    )


def formatted_address(flat_type, flat_number, building, number, street_name, street_type,
                      locality_name, state, postcode) -> Column:
    """P3: ", "-join of flat, building, number, street and locality parts (nulls skipped)."""
    return F.concat_ws(
        ", ",
        flat_part(flat_type, flat_number),
        building,
        number,
        street_part(street_name, street_type),
        locality_part(locality_name, state, postcode),
    )


def combined_number(prefix: Column, number: Column, suffix: Column) -> Column:
    """prefix||number||suffix, null when the number is missing."""
    return F.when(number.isNotNull(), F.concat_ws("", prefix, number, suffix))


def display_address(number, street_name, street_type, locality_name, state, postcode) -> Column:
    """Space-join of number, street, type, locality, state, postcode (nulls skipped)."""
    return F.concat_ws(" ", number, street_name, street_type, locality_name, state, postcode)
