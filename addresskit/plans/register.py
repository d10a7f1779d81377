"""Register ETL and gold-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.address import STATE_NAMES
from ..operators import register as R
from ..sources.fixtures import cte, derived
from . import common as C
from .registry import query

O = C.O_REGISTER


@query("etl_addresses", O + "SELECT * FROM addresses")
def etl_addresses(spark, sf):
    """S10 + P1 + F1 + F4 + J1 + J2: raw address records -> register rows (geocode and locality joins)."""
    return C.addresses(spark, sf)


@query(
    "address_statistics",
    O
    + """
SELECT l.state_code, l.locality_name,
       count(*) AS total_addresses,
       count(*) FILTER (WHERE a.address_status = 'CURRENT') AS current_addresses,
       count(*) FILTER (WHERE a.confidence_score >= 80) AS high_confidence_addresses,
       round(avg(a.confidence_score), 4) AS avg_confidence_score,
       round(avg(a.completeness_score), 4) AS avg_completeness_score,
       min(a.gnaf_date_created) AS oldest_address,
       max(a.gnaf_date_created) AS newest_address
FROM addresses a JOIN localities l ON a.locality_pid = l.locality_pid
GROUP BY l.state_code, l.locality_name
""",
)
def address_statistics(spark, sf):
    """A1 + J7: per (state, locality name) statistics; a gold table refreshed after each load."""
    a = C.addresses(spark, sf).select(
        "locality_pid", "address_status", "confidence_score", "completeness_score", "gnaf_date_created"
    )
    loc = C.localities(spark, sf).select("locality_pid", "state_code", "locality_name")
    j = a.join(loc, "locality_pid")
    return j.groupBy("state_code", "locality_name").agg(
        F.count(F.lit(1)).alias("total_addresses"),
        F.count_if(F.col("address_status") == "CURRENT").alias("current_addresses"),
        F.count_if(F.col("confidence_score") >= 80).alias("high_confidence_addresses"),
        F.round(F.avg("confidence_score"), 4).alias("avg_confidence_score"),
        F.round(F.avg("completeness_score"), 4).alias("avg_completeness_score"),
        F.min("gnaf_date_created").alias("oldest_address"),
        F.max("gnaf_date_created").alias("newest_address"),
    )


# ----------------------------------------------------------------- S6-S9, F2
_STATES_SQL = ", ".join(f"('{a}', '{b}')" for a, b in STATE_NAMES)


@query("dim_states", O + f"""
, st AS (SELECT * FROM (VALUES {_STATES_SQL}) AS t(state_code, state_name))
SELECT st.state_code, st.state_name, count(l.locality_pid) AS localities
FROM st LEFT JOIN localities l ON l.state_code = st.state_code
GROUP BY st.state_code, st.state_name""")
def dim_states(spark, sf):
    """State reference rows (nine, OT included; D3) with the number of loaded localities per state."""
    st = R.dim_states(spark)
    loc = C.localities(spark, sf).groupBy("state_code").agg(F.count(F.lit(1)).alias("localities"))
    out = F.broadcast(st).join(loc, "state_code", "left")  # 9 fixed rows
    return out.select("state_code", "state_name", F.coalesce("localities", F.lit(0)).alias("localities"))


@query("etl_localities", O + "SELECT locality_pid, locality_name, locality_class, state_code, postcode, latitude, longitude FROM localities")
def etl_localities(spark, sf):
    """Validated localities with mapped state and default class."""
    return C.localities(spark, sf)


@query(
    "locality_rejects",
    cte("loc_raw")
    + """
SELECT locality_pid, locality_name, state_pid,
       CASE WHEN locality_pid IS NULL THEN 'Missing LOCALITY_PID'
            WHEN locality_name IS NULL THEN 'Missing LOCALITY_NAME'
            WHEN state_pid IS NULL THEN 'Missing STATE_PID'
            ELSE 'Unknown STATE_PID: ' || state_pid END AS reject_reason
FROM loc_raw
WHERE locality_pid IS NULL OR locality_name IS NULL OR state_pid IS NULL
   OR state_pid NOT IN ('1','2','3','4','5','6','7','8','9')
""",
)
def locality_rejects(spark, sf):
    """rejected locality rows with the first failing reason."""
    return R.locality_rejects(derived(spark, sf, "loc_raw"))


@query("etl_streets", O + "SELECT * FROM streets")
def etl_streets(spark, sf):
    """S8 + F3: valid streets."""
    return C.streets(spark, sf)


@query("etl_geocodes", O + "SELECT * FROM geocodes")
def etl_geocodes(spark, sf):
    """One default geocode per address pid."""
    return C.geocodes(spark, sf)


# --------------------------------------------------------------- views, J3
_CURRENT_SQL = """
SELECT a.address_detail_pid, a.formatted_address, a.confidence_score, a.address_status,
       l.locality_name, l.postcode AS locality_postcode, s.street_name, s.street_type, s.street_suffix
FROM addresses a
LEFT JOIN localities l ON a.locality_pid = l.locality_pid
LEFT JOIN streets s ON a.street_locality_pid = s.street_locality_pid
WHERE a.address_status = 'CURRENT'
"""


def _current(spark, sf):
    a, loc, st = C.unsaved(spark, sf)
    a = a.select("address_detail_pid", "formatted_address", "confidence_score", "address_status", "locality_pid", "street_locality_pid")
    loc = loc.select("locality_pid", "locality_name", F.col("postcode").alias("locality_postcode"))
    st = st.select("street_locality_pid", "street_name", "street_type", "street_suffix")
    cur = a.filter(F.col("address_status") == "CURRENT")
    j = cur.join(loc, "locality_pid", "left").join(st, "street_locality_pid", "left")
    return j.drop("locality_pid", "street_locality_pid")


@query("current_addresses", O + _CURRENT_SQL)
def current_addresses(spark, sf):
    """F6 + J3: CURRENT addresses with locality and street attached by left joins."""
    return _current(spark, sf)


@query("high_confidence_addresses", O + _CURRENT_SQL + " AND a.confidence_score >= 80")
def high_confidence_addresses(spark, sf):
    """current addresses with confidence >= 80."""
    return _current(spark, sf).filter(F.col("confidence_score") >= 80)


@query(
    "address_points",
    O
    + """
, pts AS (
  SELECT address_detail_pid, 6378137 * radians(longitude) AS x,
         6378137 * ln(tan(pi() / 4 + radians(latitude) / 2)) AS y
  FROM addresses)
SELECT address_detail_pid, round(x, 2) AS x, round(y, 2) AS y,
       CAST(floor(x / 1000) AS BIGINT) AS cell_x, CAST(floor(y / 1000) AS BIGINT) AS cell_y
FROM pts
""",
)
def address_points(spark, sf):
    """EPSG:3857 point and 1 km grid cell per address."""
    p = R.address_points(C.addresses(spark, sf), 1000.0)
    return p.select("address_detail_pid", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), "cell_x", "cell_y")


@query("formatted_address", O + "SELECT address_detail_pid, address_line, formatted_address FROM addresses")
def formatted_address(spark, sf):
    """P3 + P4: formatted address and address line of the load."""
    return C.addresses(spark, sf).select("address_detail_pid", "address_line", "formatted_address")


@query(
    "display_address",
    O + "SELECT address_detail_pid, concat_ws(' ', number_first, street_name, street_type, locality_name, "
    "state_code, postcode) AS display_address FROM addresses",
)
def display_address(spark, sf):
    """Space-joined display address used by search and validation."""
    from ..functions import address as A

    c = F.col
    return C.addresses(spark, sf).select(
        "address_detail_pid",
        A.display_address(c("number_first"), c("street_name"), c("street_type"), c("locality_name"),
                          c("state_code"), c("postcode")).alias("display_address"),
    )


# ------------------------------------------------------- parser variant P2-P13
_PR = cte("parser_records")
_COMB = "CASE WHEN {n} IS NOT NULL THEN concat_ws('', {p}, {n}, {s}) END"


def _comb(p, n, s):
    return _COMB.format(p=p, n=n, s=s)


@query(
    "combined_numbers",
    _PR + f"""SELECT address_detail_pid,
  {_comb('lot_number_prefix', 'lot_number', 'lot_number_suffix')} AS lot_number,
  {_comb('flat_number_prefix', 'flat_number', 'flat_number_suffix')} AS flat_number,
  {_comb('number_first_prefix', 'number_first', 'number_first_suffix')} AS street_number
FROM parser_records""",
)
def combined_numbers(spark, sf):
    """prefix||number||suffix for lot, flat and house numbers."""
    from ..operators import parser as P

    return P.combined_numbers(derived(spark, sf, "parser_records"))


_PARSER_OK = ("address_detail_pid IS NOT NULL AND locality_name IS NOT NULL AND state_abbreviation IS NOT NULL "
              "AND latitude IS NOT NULL AND longitude IS NOT NULL")


@query(
    "formatted_address_full",
    _PR + f"""SELECT address_detail_pid, concat_ws(', ',
    CASE WHEN flat_type IS NOT NULL AND flat_number IS NOT NULL
         THEN flat_type || ' ' || {_comb('flat_number_prefix', 'flat_number', 'flat_number_suffix')} END,
    building_name,
    {_comb('number_first_prefix', 'number_first', 'number_first_suffix')},
    CASE WHEN street_name IS NOT NULL THEN concat_ws(' ', street_name, street_type_code, street_suffix_code) END,
    concat_ws(' ', locality_name, state_abbreviation, postcode)) AS formatted_address
FROM parser_records WHERE {_PARSER_OK}""",
)
def formatted_address_full(spark, sf):
    """P5: parser-variant formatted address over records that pass the parser's F1."""
    from ..operators import parser as P

    r = derived(spark, sf, "parser_records").filter(F.expr(_PARSER_OK))
    return P.formatted_full(r)


@query(
    "quality_scores",
    _PR + """SELECT address_detail_pid,
  CAST(greatest(0, 100 - CASE WHEN street_name IS NULL THEN 20 ELSE 0 END - CASE WHEN number_first IS NULL THEN 15 ELSE 0 END
       - CASE WHEN postcode IS NULL THEN 10 ELSE 0 END - CASE WHEN street_type_code IS NULL THEN 5 ELSE 0 END) AS BIGINT)
    AS confidence,
  CAST(10 * ((street_name IS NOT NULL)::INT + (number_first IS NOT NULL)::INT + (postcode IS NOT NULL)::INT
    + (street_type_code IS NOT NULL)::INT + (building_name IS NOT NULL)::INT + (flat_number IS NOT NULL)::INT
    + (lot_number IS NOT NULL)::INT + (legal_parcel_id IS NOT NULL)::INT + (geocode_type IS NOT NULL)::INT
    + (reliability IS NOT NULL)::INT) AS BIGINT) AS completeness
FROM parser_records""",
)
def quality_scores(spark, sf):
    """P7 + P8 parser variant: confidence (incl. -5 without street type) and completeness."""
    from ..operators import parser as P

    return P.parsed_columns(derived(spark, sf, "parser_records")).select(
        "address_detail_pid", "confidence", "completeness")


@query(
    "precision_map",
    _PR + """SELECT address_detail_pid, geocode_type,
  CASE WHEN geocode_type IS NULL THEN 'LOCALITY'
       WHEN upper(geocode_type) LIKE '%PROPERTY%' THEN 'PROPERTY'
       WHEN upper(geocode_type) LIKE '%STREET%' THEN 'STREET'
       WHEN upper(geocode_type) LIKE '%LOCALITY%' THEN 'LOCALITY' ELSE 'REGION' END AS precision_load,
  CASE WHEN geocode_type IS NULL THEN 'LOCALITY'
       WHEN upper(geocode_type) LIKE '%PROPERTY%' OR upper(geocode_type) LIKE '%BUILDING%' THEN 'PROPERTY'
       WHEN upper(geocode_type) LIKE '%STREET%' THEN 'STREET'
       WHEN upper(geocode_type) LIKE '%LOCALITY%' THEN 'LOCALITY' ELSE 'REGION' END AS precision_parser
FROM parser_records""",
)
def precision_map(spark, sf):
    """Coordinate precision, load and parser variants."""
    from ..functions import address as A

    g = F.col("geocode_type")
    return derived(spark, sf, "parser_records").select(
        "address_detail_pid", g, A.precision_from_type(g).alias("precision_load"),
        A.precision_from_type(g, "parser").alias("precision_parser"))


@query(
    "state_map",
    cte("loc_raw", "parser_records")
    + """SELECT 'load' AS variant, state_pid AS input_value,
       CASE state_pid WHEN '1' THEN 'NSW' WHEN '2' THEN 'VIC' WHEN '3' THEN 'QLD' WHEN '4' THEN 'SA' WHEN '5' THEN 'WA'
            WHEN '6' THEN 'TAS' WHEN '7' THEN 'NT' WHEN '8' THEN 'ACT' WHEN '9' THEN 'OT' ELSE 'NSW' END AS state_code,
       count(*) AS n
FROM loc_raw GROUP BY 1, 2, 3
UNION ALL
SELECT 'parser', state_abbreviation,
       CASE upper(state_abbreviation) WHEN 'NSW' THEN 'NSW' WHEN 'VIC' THEN 'VIC' WHEN 'QLD' THEN 'QLD' WHEN 'SA' THEN 'SA'
            WHEN 'WA' THEN 'WA' WHEN 'TAS' THEN 'TAS' WHEN 'NT' THEN 'NT' WHEN 'ACT' THEN 'ACT' ELSE 'NSW' END,
       count(*)
FROM parser_records WHERE state_abbreviation IS NOT NULL GROUP BY 1, 2, 3""",
)
def state_map(spark, sf):
    """P10: state PID (load) and abbreviation (parser) mappings with row counts."""
    from ..functions import address as A

    lr = derived(spark, sf, "loc_raw").select(
        F.lit("load").alias("variant"), F.col("state_pid").alias("input_value"),
        A.state_from_pid(F.col("state_pid")).alias("state_code"))
    pr = derived(spark, sf, "parser_records").filter(F.col("state_abbreviation").isNotNull()).select(
        F.lit("parser").alias("variant"), F.col("state_abbreviation").alias("input_value"),
        A.state_from_abbreviation(F.col("state_abbreviation")).alias("state_code"))
    return lr.unionByName(pr).groupBy("variant", "input_value", "state_code").agg(F.count(F.lit(1)).alias("n"))


@query(
    "locality_class",
    _PR + """SELECT address_detail_pid, locality_name,
  CASE WHEN lower(locality_name) LIKE '%city%' THEN 'C' WHEN lower(locality_name) LIKE '%town%' THEN 'T' ELSE 'S' END
    AS locality_class
FROM parser_records WHERE locality_name IS NOT NULL""",
)
def locality_class(spark, sf):
    """Locality class from the name (city / town / suburb)."""
    from ..functions import address as A

    r = derived(spark, sf, "parser_records").filter(F.col("locality_name").isNotNull())
    return r.select("address_detail_pid", "locality_name",
                    A.locality_class_from_name(F.col("locality_name")).alias("locality_class"))


@query(
    "reliability_map",
    _PR + """SELECT address_detail_pid, reliability,
  CAST(CASE WHEN coalesce(TRY_CAST(reliability AS INTEGER), 0) = 0 THEN 2 ELSE TRY_CAST(reliability AS INTEGER) END
       AS BIGINT) AS reliability_load,
  CAST(CASE WHEN TRY_CAST(reliability AS INTEGER) IN (1, 2, 3) THEN TRY_CAST(reliability AS INTEGER) ELSE 2 END
       AS BIGINT) AS reliability_parser
FROM parser_records""",
)
def reliability_map(spark, sf):
    """Reliability, load (int or 2) and parser (1..3 else 2) variants."""
    from ..functions import address as A

    r = F.col("reliability")
    return derived(spark, sf, "parser_records").select(
        "address_detail_pid", r, A.reliability_load(r).alias("reliability_load"),
        A.reliability_parser(r).alias("reliability_parser"))


@query(
    "status_map",
    _PR + """SELECT address_detail_pid, address_status AS input_status,
  CASE WHEN upper(address_status) LIKE '%RETIRED%' THEN 'RETIRED'
       WHEN upper(address_status) LIKE '%PROPOSED%' THEN 'PROPOSED' ELSE 'CURRENT' END AS status
FROM parser_records""",
)
def status_map(spark, sf):
    """Lifecycle status from text."""
    from ..functions import address as A

    return derived(spark, sf, "parser_records").select(
        "address_detail_pid", F.col("address_status").alias("input_status"),
        A.status_from_text(F.col("address_status")).alias("status"))


@query("address_struct")
def address_struct(spark, sf):
    """Nested address documents (struct of structs)."""
    from ..operators import parser as P

    return P.address_struct(derived(spark, sf, "parser_records"))


@query(
    "coordinate_bounds",
    O
    + """SELECT address_detail_pid,
  (latitude BETWEEN -55 AND -5 AND longitude BETWEEN 95 AND 170) AS in_load,
  (latitude BETWEEN -45 AND -8 AND longitude BETWEEN 110 AND 155) AS in_parser,
  (latitude BETWEEN -45 AND -10 AND longitude BETWEEN 110 AND 155) AS in_quality,
  (latitude BETWEEN -55 AND -9 AND longitude BETWEEN 96 AND 169) AS in_ddl,
  (latitude BETWEEN -43.7 AND -9 AND longitude BETWEEN 112 AND 154) AS in_api,
  (latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT isnan(latitude) AND NOT isnan(longitude))
    AS in_world
FROM geocodes""",
)
def coordinate_bounds(spark, sf):
    """F4 + F5: every named national box and the world/finite test, per geocode."""
    from ..functions import geo as G

    g = C.geocodes(spark, sf)
    lat, lon = F.col("latitude"), F.col("longitude")
    return g.select(
        "address_detail_pid",
        *[G.in_bounds(lat, lon, p).alias(f"in_{p}") for p in ("load", "parser", "quality", "ddl", "api")],
        G.in_world(lat, lon).alias("in_world"),
    )


# ------------------------------------------------------ S11-S17, F13
O_UPD = O + """,
loc_new AS (
  SELECT locality_pid, locality_name, coalesce(locality_class_code, 'S') AS locality_class,
         CASE state_pid WHEN '1' THEN 'NSW' WHEN '2' THEN 'VIC' WHEN '3' THEN 'QLD' WHEN '4' THEN 'SA' WHEN '5' THEN 'WA'
              WHEN '6' THEN 'TAS' WHEN '7' THEN 'NT' WHEN '8' THEN 'ACT' WHEN '9' THEN 'OT' ELSE 'NSW' END AS state_code,
         primary_postcode AS postcode, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude
  FROM loc_update
  WHERE locality_pid IS NOT NULL AND locality_name IS NOT NULL AND state_pid IN ('1','2','3','4','5','6','7','8','9')
),
streets_new AS (
  SELECT street_locality_pid, street_name, street_type_code AS street_type, street_suffix_code AS street_suffix,
         locality_pid
  FROM streets_update
),
addr_new AS (
  SELECT * REPLACE (upper(formatted_address) AS formatted_address,
                    least(confidence_score + 5, 100) AS confidence_score,
                    CAST(0 AS BIGINT) AS completeness_score, 'X' AS coordinate_crs)
  FROM addresses WHERE CAST(substr(address_detail_pid, 3) AS BIGINT) % 5 = 0
)
"""


def _upsert_sql(cur: str, new: str, key: str, cols: list[str], update: list[str]) -> str:
    out = [f"coalesce(c.{key}, n.{key}) AS {key}"]
    for col in cols:
        if col == key:
            continue
        if col in update:
            out.append(f"CASE WHEN n.{key} IS NOT NULL THEN n.{col} ELSE c.{col} END AS {col}")
        else:
            out.append(f"CASE WHEN c.{key} IS NOT NULL THEN c.{col} ELSE n.{col} END AS {col}")
    return f"SELECT {', '.join(out)} FROM {cur} c FULL OUTER JOIN {new} n ON c.{key} = n.{key}"


_LOC_COLS = ["locality_pid", "locality_name", "locality_class", "state_code", "postcode", "latitude", "longitude"]
_ST_COLS = ["street_locality_pid", "street_name", "street_type", "street_suffix", "locality_pid"]


@query("upsert_localities", O_UPD + _upsert_sql("localities", "loc_new", "locality_pid", _LOC_COLS,
                                                ["locality_name", "postcode", "latitude", "longitude"]))
def upsert_localities(spark, sf):
    """On key conflict only name, postcode, latitude, longitude change."""
    from ..operators import upsert as U

    new = R.load_localities(derived(spark, sf, "loc_update"))
    return U.upsert(C.localities(spark, sf), new, "locality_pid", ["locality_name", "postcode", "latitude", "longitude"])


@query("upsert_streets", O_UPD + _upsert_sql("streets", "streets_new", "street_locality_pid", _ST_COLS,
                                             ["street_name", "street_type", "street_suffix"]))
def upsert_streets(spark, sf):
    """On key conflict name, type and suffix change; the locality stays."""
    from ..operators import upsert as U

    new = R.load_streets(derived(spark, sf, "streets_update"))
    return U.upsert(C.streets(spark, sf), new, "street_locality_pid", ["street_name", "street_type", "street_suffix"])


def _address_delivery(a):
    """A second address delivery: every fifth pid re-scored (formatted text, confidence, completeness, crs)."""
    pick = F.substring("address_detail_pid", 3, 64).cast("long") % 5 == 0
    repl = {
        "formatted_address": F.upper("formatted_address"),
        "confidence_score": F.least(F.col("confidence_score") + 5, F.lit(100)),
        "completeness_score": F.lit(0),
        "coordinate_crs": F.lit("X"),
    }
    return a.filter(pick).select(*[repl.get(c, F.col(c)).alias(c) for c in a.columns])


@query("upsert_addresses", O_UPD + _upsert_sql("addresses", "addr_new", "address_detail_pid", R.ADDRESS_COLUMNS,
                                               ["formatted_address", "confidence_score", "completeness_score"]))
def upsert_addresses(spark, sf):
    """On key conflict only formatted address, confidence and completeness change."""
    from ..operators import upsert as U

    a = C.addresses(spark, sf)
    return U.upsert(a, _address_delivery(a), "address_detail_pid",
                    ["formatted_address", "confidence_score", "completeness_score"])


ROLLBACK_BATCH = "1995"


@query("rollback_batch", O + f"SELECT * FROM addresses WHERE import_batch_id IS NULL OR import_batch_id <> '{ROLLBACK_BATCH}'")
def rollback_batch(spark, sf):
    """Remove one import batch (dynamic partition overwrite of that batch when written)."""
    from ..operators import upsert as U

    return U.rollback_batch(C.addresses(spark, sf), "import_batch_id", ROLLBACK_BATCH)


@query(
    "table_counts",
    O + """SELECT 'states' AS table_name, CAST(9 AS BIGINT) AS row_count
UNION ALL SELECT 'localities', count(*) FROM localities
UNION ALL SELECT 'streets', count(*) FROM streets
UNION ALL SELECT 'addresses', count(*) FROM addresses""",
)
def table_counts(spark, sf):
    """Row count of the four register tables in one UNION ALL."""
    from ..operators import upsert as U

    return U.table_counts({
        "states": R.dim_states(spark), "localities": C.localities(spark, sf),
        "streets": C.streets(spark, sf), "addresses": C.addresses(spark, sf),
    })


@query(
    "import_summary",
    O + """, s AS (SELECT (SELECT count(*) FROM address_detail) AS processed, (SELECT count(*) FROM addresses) AS valid)
SELECT processed, valid, processed - valid AS invalid, valid AS inserted, CAST(0 AS BIGINT) AS failed,
       round(CASE WHEN processed > 0 THEN CAST(valid AS DOUBLE) / processed * 100 ELSE 0 END, 2) AS success_rate
FROM s""",
)
def import_summary(spark, sf):
    """Processed / valid / invalid / inserted / failed and success rate of one load."""
    processed = derived(spark, sf, "address_detail").agg(F.count(F.lit(1)).alias("processed"))
    valid = C.addresses(spark, sf).agg(F.count(F.lit(1)).alias("valid"))
    s = processed.crossJoin(valid)  # two 1-row aggregates
    return s.select(
        "processed", "valid", (F.col("processed") - F.col("valid")).alias("invalid"),
        F.col("valid").alias("inserted"), F.lit(0).cast("long").alias("failed"),
        F.round(F.when(F.col("processed") > 0, F.col("valid").cast("double") / F.col("processed") * 100)
                .otherwise(0.0), 2).alias("success_rate"),
    )


REJECT_BUDGET = 1000


@query(
    "reject_budget",
    O + f"""SELECT count(*) AS rejects, CAST({REJECT_BUDGET} AS BIGINT) AS budget, count(*) > {REJECT_BUDGET} AS exceeded
FROM address_detail d WHERE NOT EXISTS (SELECT 1 FROM addresses a WHERE a.address_detail_pid = d.address_detail_pid)""",
)
def reject_budget(spark, sf):
    """rows the load rejected, against the 1000-row budget (the driver raises when exceeded)."""
    d = derived(spark, sf, "address_detail").select("address_detail_pid")
    rej = d.join(C.addresses(spark, sf).select("address_detail_pid"), "address_detail_pid", "left_anti")
    return rej.agg(F.count(F.lit(1)).alias("rejects")).select(
        "rejects", F.lit(REJECT_BUDGET).cast("long").alias("budget"),
        (F.col("rejects") > REJECT_BUDGET).alias("exceeded"))
