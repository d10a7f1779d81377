"""Request validation, mixed spatial batches, table standardisation and IP enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bodies as B
from ..functions import geo as G
from ..operators import spatial as S
from ..sources.fixtures import cte, derived
from . import common as C
from . import spatial as SP
from . import text as TX
from .registry import ORACLES, query

MAX_RADIUS = 5000
MAX_LIMIT = 50
VALID_TYPES = ("proximity", "boundary", "statistical")


def _finite(c):
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def request_error_code(df):
    """first failing rule per operation type (the codes of the request contract)."""
    lat, lon, addr = F.col("latitude"), F.col("longitude"), F.col("address")
    has_coords = lat.isNotNull() & lon.isNotNull()
    finite = _finite(lat) & _finite(lon)
    in_box = G.in_bounds(lat, lon, "api")
    bad_addr = addr.isNotNull() & (F.length(F.trim(addr)) < 3)
    bad_radius = F.col("radius").isNotNull() & ((F.col("radius") < 1) | (F.col("radius") > MAX_RADIUS))
    bad_limit = F.col("max_results").isNotNull() & ((F.col("max_results") < 1) | (F.col("max_results") > MAX_LIMIT))
    t = F.col("op_type")
    located = (F.when(~has_coords & addr.isNull(), F.lit("MISSING_LOCATION"))
               .when(has_coords & ~finite, F.lit("INVALID_COORDINATES"))
               .when(has_coords & ~in_box, F.lit("COORDINATES_OUT_OF_BOUNDS"))
               .when(bad_addr, F.lit("INVALID_ADDRESS")))
    prox = located.when(bad_radius, F.lit("INVALID_RADIUS")).when(bad_limit, F.lit("INVALID_LIMIT"))
    bnd = (F.when(~has_coords, F.lit("MISSING_COORDINATES")).when(~finite, F.lit("INVALID_COORDINATES"))
           .when(~in_box, F.lit("COORDINATES_OUT_OF_BOUNDS")))
    return (F.when(~t.isin(*VALID_TYPES), F.lit("INVALID_OPERATION_TYPE"))
            .when(t == "proximity", prox).when(t == "boundary", bnd).otherwise(located))


_ERR_SQL = """CASE WHEN op_type NOT IN ('proximity', 'boundary', 'statistical') THEN 'INVALID_OPERATION_TYPE'
  WHEN op_type = 'boundary' THEN CASE WHEN latitude IS NULL OR longitude IS NULL THEN 'MISSING_COORDINATES'
       WHEN isnan(latitude) OR isnan(longitude) OR isinf(latitude) OR isinf(longitude) THEN 'INVALID_COORDINATES'
       WHEN NOT (latitude BETWEEN -43.7 AND -9 AND longitude BETWEEN 112 AND 154) THEN 'COORDINATES_OUT_OF_BOUNDS' END
  ELSE CASE WHEN (latitude IS NULL OR longitude IS NULL) AND address IS NULL THEN 'MISSING_LOCATION'
       WHEN latitude IS NOT NULL AND longitude IS NOT NULL
            AND (isnan(latitude) OR isnan(longitude) OR isinf(latitude) OR isinf(longitude)) THEN 'INVALID_COORDINATES'
       WHEN latitude IS NOT NULL AND longitude IS NOT NULL
            AND NOT (latitude BETWEEN -43.7 AND -9 AND longitude BETWEEN 112 AND 154) THEN 'COORDINATES_OUT_OF_BOUNDS'
       WHEN address IS NOT NULL AND length(trim(address)) < 3 THEN 'INVALID_ADDRESS'
       WHEN op_type = 'proximity' AND radius IS NOT NULL AND (radius < 1 OR radius > 5000) THEN 'INVALID_RADIUS'
       WHEN op_type = 'proximity' AND max_results IS NOT NULL AND (max_results < 1 OR max_results > 50) THEN 'INVALID_LIMIT'
       END END"""

O_API = C.register_sql("api_requests", "boundaries") + TX.O_TXT.removeprefix(C.register_sql("requests_text")) + TX._GEO + f""",
api AS (SELECT *, {_ERR_SQL} AS error_code FROM api_requests)
"""


@query("request_errors", O_API + "SELECT request_id, batch_id, op_type, error_code FROM api")
def request_errors(spark, sf):
    """validation error code per operation (null when valid)."""
    r = derived(spark, sf, "api_requests")
    return r.select("request_id", "batch_id", "op_type", request_error_code(r).alias("error_code"))


# The code that each case of the fixture must get by the rules of the request contract.
EXPECTED_CODES = {
    1: "MISSING_LOCATION", 2: "MISSING_LOCATION", 3: "INVALID_COORDINATES", 4: "INVALID_COORDINATES", 5: "COORDINATES_OUT_OF_BOUNDS",
    6: "INVALID_ADDRESS", 7: "INVALID_ADDRESS", 8: "INVALID_RADIUS", 9: "INVALID_RADIUS", 10: "INVALID_RADIUS", 11: "INVALID_LIMIT",
    12: "INVALID_PROPERTY_TYPES", 13: "INVALID_PROPERTY_TYPES", 14: "INVALID_INCLUDE_DISTANCE", 15: "INVALID_INCLUDE_BEARING",
    16: "VALIDATION_ERROR", 18: "MISSING_COORDINATES", 19: "INVALID_COORDINATES", 20: "COORDINATES_OUT_OF_BOUNDS",
    21: "INVALID_BOOLEAN_FLAG", 22: "INVALID_BOOLEAN_FLAG", 24: "MISSING_LOCATION", 25: "INVALID_COORDINATES",
    26: "COORDINATES_OUT_OF_BOUNDS", 27: "INVALID_ADDRESS", 28: "INVALID_INCLUDE_HIERARCHY", 30: "MISSING_OPERATIONS",
    31: "MISSING_OPERATIONS", 32: "INVALID_OPERATION_ID", 33: "INVALID_OPERATION_TYPE", 34: "MISSING_PARAMETERS",
    35: "INVALID_OPERATION_ID", 36: "INVALID_BATCH_SIZE", 37: "INVALID_PROGRESS_CALLBACK", 38: "INVALID_FAIL_FAST", 39: "MISSING_QUERY",
    40: "INVALID_LIMIT", 42: "MISSING_QUERY", 43: "MISSING_ADDRESS", 44: "MISSING_ADDRESS", 45: "ADDRESS_TOO_LONG",
    47: "INVALID_COORDINATE_SYSTEM", 49: "MISSING_ADDRESS", 50: "ADDRESS_TOO_LONG", 52: "INVALID_COORDINATES", 53: "INVALID_LATITUDE",
    54: "INVALID_LONGITUDE", 55: "INVALID_COORDINATE_SYSTEM", 56: "INVALID_RADIUS", 57: "INVALID_LIMIT", 58: "BATCH_TOO_LARGE"}


@query("body_errors", cte("api_bodies") + ", expected AS (SELECT * FROM (VALUES "
       + ", ".join(f"({k}, '{v}')" for k, v in EXPECTED_CODES.items()) + """) AS t(case_no, error_code))
SELECT b.request_id, b.kind, e.error_code FROM api_bodies b LEFT JOIN expected e ON e.case_no = b.case_no""")
def body_errors(spark, sf):
    """the first broken rule of each JSON request body (proximity, boundary, statistical, batch, search, validate, geocode, reverse)."""
    return B.with_error_code(derived(spark, sf, "api_bodies"), "kind", "body").select("request_id", "kind", "error_code")


def batch_frame(spark, sf):
    """Route each valid operation to its join, error rows for the rest, one row per operation.

    An operation without coordinates is geocoded from its address first (P18); only those are.
    """
    r = derived(spark, sf, "api_requests")
    r = r.withColumn("error_code", request_error_code(r))
    has = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    texts = r.filter(F.col("error_code").isNull() & ~has).select("request_id", F.col("address").alias("address_text"))
    found = TX.geocode_frame(spark, sf, texts).select("request_id", "success", F.col("latitude").alias("g_lat"), F.col("longitude").alias("g_lon"))
    r = C.cut(r.join(found, "request_id", "left"))
    r = r.withColumn("error_code", F.when(~F.col("success"), F.lit("GEOCODING_FAILED")).otherwise(F.col("error_code")))
    lat = F.when(has, F.round("latitude", 7)).otherwise(F.col("g_lat"))
    lon = F.when(has, F.round("longitude", 7)).otherwise(F.col("g_lon"))
    ok = r.filter(F.col("error_code").isNull()).select(
        "request_id", "op_type", lat.alias("req_lat"), lon.alias("req_lon"),
        F.coalesce("radius", F.lit(1000)).alias("radius"), F.coalesce("max_results", F.lit(10)).alias("k"))
    ok = C.cut(ok.withColumn("rx", G.mercator_x(F.col("req_lon"))).withColumn("ry", G.mercator_y(F.col("req_lat"))))
    pts = S.with_xy(C.addresses(spark, sf)).select("gnaf_pid", "x", "y")

    prox_req = ok.filter(F.col("op_type") == "proximity")
    pairs = S.nearest(prox_req, pts, F.col("radius"), [F.col("gnaf_pid")], MAX_LIMIT, F.col("k"))
    pairs = pairs.withColumn("distance_meters", F.round("distance_m").cast("long"))
    top = S.top_k(pairs, "request_id", [F.col("distance_meters"), F.col("gnaf_pid")], MAX_LIMIT, F.col("k"))
    prox = top.groupBy("request_id").agg(F.count(F.lit(1)).alias("result_count"),
                                         F.min_by("gnaf_pid", "rank").alias("first_result"))
    prox = prox_req.select("request_id").join(prox, "request_id", "left").select(
        "request_id", F.coalesce("result_count", F.lit(0)).alias("result_count"), "first_result",
        F.lit(None).cast("string").alias("op_error"))

    bnd_req = ok.filter(F.col("op_type") == "boundary").select("request_id", F.col("req_lon").alias("px"),
                                                               F.col("req_lat").alias("py"))
    polys = S.polygon_index(derived(spark, sf, "boundaries"))
    hits = S.contains_join(bnd_req, polys).groupBy("request_id").agg(F.min("boundary_id").alias("first_result"))
    bnd = bnd_req.select("request_id").join(hits, "request_id", "left").select(
        "request_id", F.when(F.col("first_result").isNotNull(), 1).otherwise(0).alias("result_count"),
        "first_result", F.when(F.col("first_result").isNull(), F.lit("NO_BOUNDARY_FOUND")).alias("op_error"))

    st_req = ok.filter(F.col("op_type") == "statistical")
    sp = S.nearest(st_req, pts, F.lit(SP.STAT_TOLERANCE_M), [F.col("gnaf_pid")], 1)
    near = S.top_k(sp, "request_id", [F.round("distance_m", 4), F.col("gnaf_pid")], 1).select(
        "request_id", F.col("gnaf_pid").alias("first_result"))
    stat = st_req.select("request_id").join(near, "request_id", "left").select(
        "request_id", F.when(F.col("first_result").isNotNull(), 1).otherwise(0).alias("result_count"),
        "first_result", F.when(F.col("first_result").isNull(), F.lit("NO_ADDRESS_WITHIN_TOLERANCE")).alias("op_error"))

    done = prox.unionByName(bnd).unionByName(stat)
    out = r.select("request_id", "batch_id", "op_type", "error_code").join(done, "request_id", "left")
    err = F.coalesce(F.col("error_code"), F.col("op_error"))
    return out.select("batch_id", "request_id", "op_type",
                      F.when(err.isNull(), "success").otherwise("error").alias("status"), err.alias("error"),
                      F.coalesce("result_count", F.lit(0)).cast("long").alias("result_count"), "first_result")


_XY = SP._xy_sql
_RX, _RY = _XY("lat", "lon")
_PX, _PY = _XY("latitude", "longitude")
O_BATCH = O_API + f""",
api2 AS (SELECT a.* REPLACE (CASE WHEN a.error_code IS NULL AND (a.latitude IS NULL OR a.longitude IS NULL) AND NOT g.success
                                    THEN 'GEOCODING_FAILED' ELSE a.error_code END AS error_code),
                g.latitude AS g_lat, g.longitude AS g_lon FROM api a JOIN geo g ON g.request_id = a.request_id),
ok AS (SELECT request_id, op_type, CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN round(latitude, 7) ELSE g_lat END AS lat,
              CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN round(longitude, 7) ELSE g_lon END AS lon,
              coalesce(radius, 1000) AS radius, coalesce(max_results, 10) AS k FROM api2 WHERE error_code IS NULL),
okxy AS (SELECT *, {_RX} AS rx, {_RY} AS ry FROM ok),
pts AS (SELECT gnaf_pid, {_PX} AS x, {_PY} AS y FROM addresses),
pp AS (SELECT r.request_id, p.gnaf_pid, round(sqrt((p.x - r.rx) * (p.x - r.rx) + (p.y - r.ry) * (p.y - r.ry))) AS dm,
              row_number() OVER (PARTITION BY r.request_id ORDER BY round(sqrt((p.x - r.rx) * (p.x - r.rx)
                + (p.y - r.ry) * (p.y - r.ry))), p.gnaf_pid) AS rk, r.k
       FROM okxy r JOIN pts p ON p.x BETWEEN r.rx - r.radius AND r.rx + r.radius
                             AND p.y BETWEEN r.ry - r.radius AND r.ry + r.radius
       WHERE r.op_type = 'proximity' AND sqrt((p.x - r.rx) * (p.x - r.rx) + (p.y - r.ry) * (p.y - r.ry)) <= r.radius),
prox AS (SELECT request_id, count(*) AS result_count, min(gnaf_pid) FILTER (WHERE rk = 1) AS first_result
         FROM pp WHERE rk <= k GROUP BY 1),
nv AS (SELECT boundary_id, count(*) AS n FROM boundaries GROUP BY 1),
edges AS (SELECT b.boundary_id, b.x AS x1, b.y AS y1, b2.x AS x2, b2.y AS y2
          FROM boundaries b JOIN nv ON nv.boundary_id = b.boundary_id
          JOIN boundaries b2 ON b2.boundary_id = b.boundary_id AND b2.vertex_no = (b.vertex_no + 1) % nv.n),
bh AS (SELECT r.request_id, e.boundary_id FROM ok r CROSS JOIN edges e WHERE r.op_type = 'boundary'
       GROUP BY 1, 2
       HAVING sum(CASE WHEN (e.y1 > r.lat) <> (e.y2 > r.lat)
                        AND r.lon < (e.x2 - e.x1) * (r.lat - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) % 2 = 1),
bnd AS (SELECT request_id, min(boundary_id) AS first_result FROM bh GROUP BY 1),
sap AS (SELECT r.request_id, p.gnaf_pid,
              row_number() OVER (PARTITION BY r.request_id ORDER BY round(sqrt((p.x - r.rx) * (p.x - r.rx)
                + (p.y - r.ry) * (p.y - r.ry)), 4), p.gnaf_pid) AS rk
       FROM okxy r JOIN pts p ON p.x BETWEEN r.rx - 100 AND r.rx + 100 AND p.y BETWEEN r.ry - 100 AND r.ry + 100
       WHERE r.op_type = 'statistical' AND sqrt((p.x - r.rx) * (p.x - r.rx) + (p.y - r.ry) * (p.y - r.ry)) <= 100),
stat AS (SELECT request_id, gnaf_pid AS first_result FROM sap WHERE rk = 1),
res AS (
  SELECT a.batch_id, a.request_id, a.op_type,
         coalesce(a.error_code,
                  CASE WHEN a.op_type = 'boundary' AND b.first_result IS NULL THEN 'NO_BOUNDARY_FOUND'
                       WHEN a.op_type = 'statistical' AND s.first_result IS NULL THEN 'NO_ADDRESS_WITHIN_TOLERANCE' END)
           AS error,
         CAST(CASE WHEN a.error_code IS NOT NULL THEN 0 WHEN a.op_type = 'proximity' THEN coalesce(p.result_count, 0)
                   WHEN a.op_type = 'boundary' THEN CASE WHEN b.first_result IS NULL THEN 0 ELSE 1 END
                   ELSE CASE WHEN s.first_result IS NULL THEN 0 ELSE 1 END END AS BIGINT) AS result_count,
         CASE WHEN a.error_code IS NOT NULL THEN NULL WHEN a.op_type = 'proximity' THEN p.first_result
              WHEN a.op_type = 'boundary' THEN b.first_result ELSE s.first_result END AS first_result
  FROM api2 a LEFT JOIN prox p ON p.request_id = a.request_id LEFT JOIN bnd b ON b.request_id = a.request_id
  LEFT JOIN stat s ON s.request_id = a.request_id)
"""


@query("batch_analyze", O_BATCH + """SELECT batch_id, request_id, op_type,
  CASE WHEN error IS NULL THEN 'success' ELSE 'error' END AS status, error, result_count, first_result FROM res""")
def batch_analyze(spark, sf):
    """Mixed batch of proximity / boundary / statistical operations; per-operation errors kept as rows."""
    return batch_frame(spark, sf)


@query("batch_summary", O_BATCH + """SELECT batch_id, count(*) AS total,
  count(*) FILTER (WHERE error IS NULL) AS successful, count(*) FILTER (WHERE error IS NOT NULL) AS failed
FROM res GROUP BY batch_id""")
def batch_summary(spark, sf):
    """Total, successful and failed operations per batch."""
    b = batch_frame(spark, sf)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"),
                                     F.count_if(F.col("status") == "success").alias("successful"),
                                     F.count_if(F.col("status") == "error").alias("failed"))


@query("standardise_table")
def standardise_table(spark, sf):
    """Validate every row of a client address table and write back the standard address and coordinates."""
    client = derived(spark, sf, "requests_text").select("request_id", "address_text")
    v = TX.validate_addresses(spark, sf).select("request_id", "is_valid", "gnaf_pid", "standardized_address")
    a = C.addresses(spark, sf).select("gnaf_pid", "latitude", "longitude")
    j = client.join(v, "request_id", "left").join(a, "gnaf_pid", "left")
    ok = F.coalesce(F.col("is_valid"), F.lit(False))
    return j.select("request_id", "address_text", ok.alias("is_valid"),
                    F.when(ok, F.col("standardized_address")).otherwise(F.col("address_text")).alias("standard_address"),
                    F.when(ok, F.col("latitude")).alias("latitude"), F.when(ok, F.col("longitude")).alias("longitude"),
                    F.when(ok, F.col("gnaf_pid")).alias("gnaf_pid"))


def _standardise_sql():
    v = ORACLES["validate_addresses"]
    cut = v.index("\nSELECT request_id, 'exact' AS match_type")
    return v[:cut] + ",\nva AS (" + v[cut:] + """)
SELECT q.request_id, q.address_text, coalesce(va.is_valid, false) AS is_valid,
       CASE WHEN coalesce(va.is_valid, false) THEN va.standardized_address ELSE q.address_text END AS standard_address,
       CASE WHEN coalesce(va.is_valid, false) THEN a.latitude END AS latitude,
       CASE WHEN coalesce(va.is_valid, false) THEN a.longitude END AS longitude,
       CASE WHEN coalesce(va.is_valid, false) THEN va.gnaf_pid END AS gnaf_pid
FROM rq q LEFT JOIN va ON va.request_id = q.request_id LEFT JOIN addresses a ON a.gnaf_pid = va.gnaf_pid"""


ORACLES["standardise_table"] = _standardise_sql()


def _ip_long(ip):
    p = F.split(ip, r"\.")
    return (F.element_at(p, 1).cast("long") * 16777216 + F.element_at(p, 2).cast("long") * 65536
            + F.element_at(p, 3).cast("long") * 256 + F.element_at(p, 4).cast("long"))


def prefixes(ranges):
    """The blocks of addresses that make up each range ``base..last``: rows ``bits, block``, at most two for each size.

    A block of size 2^bits is taken where the range begins at an odd or ends behind an even multiple of it, so that no
    two of them make up a larger one; a range of any width has at most 64.
    """
    r = ranges.withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit(32))))
    size = F.expr("shiftleft(CAST(1 AS BIGINT), bits)")
    low, high = F.floor((F.col("base") + size - 1) / size).cast("long"), F.floor((F.col("last") + 1) / size).cast("long")
    r = r.withColumn("low", low).withColumn("high", high).where("low < high")
    taken = F.array(F.when(F.col("low") % 2 == 1, F.col("low")), F.when(F.col("high") % 2 == 1, F.col("high") - 1))
    return r.withColumn("block", F.explode(F.filter(taken, lambda x: x.isNotNull()))).drop("low", "high")


@query("ip_enrich", C.register_sql("request_log", "ip_ranges") + """,
rng AS (SELECT cidr, country, CAST(split_part(cidr, '/', 2) AS INTEGER) AS plen,
               (CAST(string_split(split_part(cidr, '/', 1), '.')[1] AS BIGINT) * 16777216
                + CAST(string_split(split_part(cidr, '/', 1), '.')[2] AS BIGINT) * 65536
                + CAST(string_split(split_part(cidr, '/', 1), '.')[3] AS BIGINT) * 256
                + CAST(string_split(split_part(cidr, '/', 1), '.')[4] AS BIGINT)) AS base FROM ip_ranges),
rng2 AS (SELECT *, base + CAST(pow(2, 32 - plen) AS BIGINT) - 1 AS last FROM rng),
ips AS (SELECT DISTINCT ip, CAST(string_split(ip, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(ip, '.')[2] AS BIGINT) * 65536
               + CAST(string_split(ip, '.')[3] AS BIGINT) * 256 + CAST(string_split(ip, '.')[4] AS BIGINT) AS v
        FROM request_log WHERE ip NOT IN ('127.0.0.1', '::1')),
m AS (SELECT i.ip, r.cidr, r.country, row_number() OVER (PARTITION BY i.ip ORDER BY r.plen DESC, r.cidr) AS rk
      FROM ips i JOIN rng2 r ON i.v BETWEEN r.base AND r.last)
SELECT ip, cidr, country FROM m WHERE rk = 1""")
def ip_enrich(spark, sf):
    """J22 re-aimed: longest-prefix CIDR match of each distinct client IP, one equi-join on (block size, block).

    A range becomes its few blocks, however wide it is; an address looks up one block for each size that occurs (at most 33).
    """
    ipr = derived(spark, sf, "ip_ranges")
    base = _ip_long(F.split("cidr", "/").getItem(0))
    plen = F.split("cidr", "/").getItem(1).cast("int")
    r = ipr.select("cidr", "country", plen.alias("plen"), base.alias("base"))
    r = prefixes(r.withColumn("last", F.col("base") + F.expr("shiftleft(CAST(1 AS BIGINT), 32 - plen)") - 1))
    sizes = sorted(x["bits"] for x in r.select("bits").distinct().collect())  # at most 33
    ips = derived(spark, sf, "request_log").select("ip").filter(~F.col("ip").isin("127.0.0.1", "::1")).distinct()
    ips = ips.withColumn("v", _ip_long(F.col("ip"))).withColumn("bits", F.explode(F.array(*[F.lit(x) for x in sizes]).cast("array<int>")))
    j = ips.withColumn("block", F.expr("shiftright(v, bits)")).join(r, ["bits", "block"])
    best = S.top_k(j, "ip", [F.desc("plen"), F.col("cidr")], 1)
    return best.select("ip", "cidr", "country")
