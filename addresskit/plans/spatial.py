"""Spatial queries: proximity, reverse geocode, statistical area, boundaries, hotspots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codes as K
from ..functions import geo as G
from ..operators import spatial as S
from ..sources.fixtures import derived
from . import common as C
from .registry import query

O = C.O_REGISTER

# request parameter limits (fixed values of the service contract)
PROXIMITY_RADIUS = (1, 5000, 1000)
PROXIMITY_LIMIT = (1, 50, 10)
REVERSE_RADIUS = (1, 1000, 100)
REVERSE_LIMIT = (1, 10, 1)
STAT_TOLERANCE_M = 100.0


def _clamp(c, lo_hi_default):
    lo, hi, d = lo_hi_default
    return F.least(F.greatest(F.coalesce(c, F.lit(d)), F.lit(lo)), F.lit(hi))


def _sql_clamp(c, lo_hi_default):
    lo, hi, d = lo_hi_default
    return f"least(greatest(coalesce({c}, {d}), {lo}), {hi})"


def _xy_sql(lat, lon):
    return (f"6378137 * radians({lon})", f"6378137 * ln(tan(pi() / 4 + radians({lat}) / 2))")


def normalised_requests(spark, sf, radius=PROXIMITY_RADIUS, limit=PROXIMITY_LIMIT):
    """P19 + X11: clamp radius and limit, round coordinates to 7 dp, add planar rx/ry."""
    r = derived(spark, sf, "requests_point").select(
        "request_id",
        F.round("latitude", 7).alias("req_lat"),
        F.round("longitude", 7).alias("req_lon"),
        _clamp(F.col("radius"), radius).cast("long").alias("radius"),
        _clamp(F.col("max_results"), limit).cast("long").alias("k"),
    )
    return r.withColumn("rx", G.mercator_x(F.col("req_lon"))).withColumn("ry", G.mercator_y(F.col("req_lat")))


def _points(spark, sf, current_only=False):
    a = C.addresses(spark, sf)
    if current_only:
        a = a.filter(F.col("address_status") == "CURRENT")
    return S.with_xy(a)


def _o_req(radius, limit, radius_sql=None, where="TRUE"):
    rx, ry = _xy_sql("lat", "lon")
    px, py = _xy_sql("latitude", "longitude")
    rad = radius_sql or _sql_clamp("radius", radius)
    return C.register_sql("requests_point", "cities", "boundaries", "regions") + f""",
req0 AS (SELECT request_id, round(latitude, 7) AS lat, round(longitude, 7) AS lon,
                {rad} AS radius, {_sql_clamp('max_results', limit)} AS k
         FROM requests_point),
req AS (SELECT *, {rx} AS rx, {ry} AS ry FROM req0),
pts AS (SELECT *, {px} AS x, {py} AS y FROM addresses WHERE {where}),
pairs AS (
  SELECT r.request_id, r.lat AS req_lat, r.lon AS req_lon, r.k, p.*,
         sqrt((p.x - r.rx) * (p.x - r.rx) + (p.y - r.ry) * (p.y - r.ry)) AS distance_m
  FROM req r JOIN pts p ON p.x BETWEEN r.rx - r.radius AND r.rx + r.radius
                       AND p.y BETWEEN r.ry - r.radius AND r.ry + r.radius
  WHERE sqrt((p.x - r.rx) * (p.x - r.rx) + (p.y - r.ry) * (p.y - r.ry)) <= r.radius
)
"""


_BEARING_SQL = ("floor(fmod(degrees(atan2(sin(radians(longitude - req_lon)) * cos(radians(latitude)), "
                "cos(radians(req_lat)) * sin(radians(latitude)) - sin(radians(req_lat)) * cos(radians(latitude)) "
                "* cos(radians(longitude - req_lon)))) + 360, 360) * 100 + 0.5) / 100")


def _haversine_sql(lat1, lon1, lat2, lon2):
    return (f"2 * 6371000 * atan2(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
            f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)), sqrt(1 - (pow(sin(radians({lat2} - "
            f"{lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))")


def _prox_frame(spark, sf):
    req = normalised_requests(spark, sf)
    pts = _points(spark, sf).select("gnaf_pid", "formatted_address", "latitude", "longitude", "x", "y")
    pairs = S.nearest(req, pts, F.col("radius"), [F.col("gnaf_pid")], PROXIMITY_LIMIT[1], F.col("k"))
    pairs = pairs.withColumn("distance_meters", F.round("distance_m").cast("long"))
    return S.top_k(pairs, "request_id", [F.col("distance_meters"), F.col("gnaf_pid")], PROXIMITY_LIMIT[1], F.col("k"))


@query(
    "proximity",
    None,
)
def proximity(spark, sf):
    """J11 + T7 + X9 + X15: addresses within each request's radius, nearest k by rounded planar metres."""
    top = _prox_frame(spark, sf)
    c = F.col
    return top.select(
        "request_id", "gnaf_pid", c("formatted_address").alias("address"), "latitude", "longitude",
        "distance_meters",
        (F.round(c("distance_meters") / 1000 * 100) / 100).alias("distance_km"),
        G.round_half_up(G.bearing_deg(c("req_lat"), c("req_lon"), c("latitude"), c("longitude")), 2).alias("bearing"),
        c("rank").cast("long").alias("rank"),
    )


@query("proximity_summary", None)
def proximity_summary(spark, sf):
    """Per request hit count and mean of the rounded metres (rounded)."""
    top = _prox_frame(spark, sf)
    return top.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.floor(F.avg("distance_meters") + 0.5).cast("long").alias("average_distance"),
    )


def _reverse_frame(spark, sf):
    req = normalised_requests(spark, sf, REVERSE_RADIUS, REVERSE_LIMIT)
    pts = _points(spark, sf, current_only=True).select(
        "gnaf_pid", "formatted_address", "latitude", "longitude", "x", "y", "coordinate_reliability",
        "number_first", "street_name", "street_type", "locality_name", "state_code", "postcode")
    pairs = S.nearest(req, pts, F.col("radius"), [F.col("coordinate_reliability"), F.col("gnaf_pid")], REVERSE_LIMIT[1],
                      F.col("k"))
    order = [F.round("distance_m", 4), F.col("coordinate_reliability"), F.col("gnaf_pid")]
    return S.top_k(pairs, "request_id", order, REVERSE_LIMIT[1], F.col("k"))


@query("reverse_geocode", None)
def reverse_geocode(spark, sf):
    """J12 + T6 + X20: CURRENT addresses within <= 1000 m, nearest first, reliability next."""
    top = _reverse_frame(spark, sf)
    c = F.col
    m = G.haversine_m(c("req_lat"), c("req_lon"), c("latitude"), c("longitude"))
    rel = c("coordinate_reliability")
    return top.select(
        "request_id", "gnaf_pid", "formatted_address", "number_first", "street_name", "street_type",
        "locality_name", "state_code", "postcode",
        G.round_half_up(m, 2).alias("distance_m"),
        (F.floor(m / 10 + 0.5) / 100).alias("distance_km"),
        G.round_half_up(G.bearing_deg(c("req_lat"), c("req_lon"), c("latitude"), c("longitude")), 2).alias("bearing"),
        F.when(rel == 1, 90).when(rel == 2, 75).otherwise(60).cast("long").alias("confidence"),
        c("rank").cast("long").alias("rank"),
    )


@query("statistical_area", None)
def statistical_area(spark, sf):
    """J14 + X16 + X17: statistical codes of the nearest address within 100 planar metres."""
    req = normalised_requests(spark, sf)
    pts = _points(spark, sf).select("gnaf_pid", "x", "y", "statistical_area_2", "mesh_block_code", "locality_pid")
    pairs = S.nearest(req, pts, F.lit(STAT_TOLERANCE_M), [F.col("gnaf_pid")], 1)
    top = S.top_k(pairs, "request_id", [F.round("distance_m", 4), F.col("gnaf_pid")], 1)
    return _sa_columns(top.select("request_id", "gnaf_pid", "statistical_area_2", "mesh_block_code",
                                  "locality_pid"), keep=["request_id", "gnaf_pid", "locality_pid"])


def _centroid_aggs():
    """Centroid of distinct points in exact integer units of 1e-7 degree (order-independent sums)."""
    return [
        F.sum(F.round(F.col("latitude") * 1e7).cast("long")).alias("_slat"),
        F.sum(F.round(F.col("longitude") * 1e7).cast("long")).alias("_slon"),
        F.count(F.lit(1)).alias("_np"),
    ]


def _centroid_cols():
    return [
        (F.floor(F.col("_slat").cast("double") / F.col("_np")) / 1e7).alias("center_lat"),
        (F.floor(F.col("_slon").cast("double") / F.col("_np")) / 1e7).alias("center_lon"),
    ]


def _sa_columns(df, keep):
    c = F.col
    sa1 = F.coalesce(F.substring("mesh_block_code", 1, 11), F.lit("Unknown"))
    sa2 = F.coalesce(c("statistical_area_2"), F.lit("Unknown"))
    sa3 = K.sa3_from_sa2(c("statistical_area_2"))
    sa4 = K.sa4_from_sa2(c("statistical_area_2"))
    return df.select(
        *keep,
        sa1.alias("sa1_code"), K.sa_name(c("mesh_block_code").substr(1, 11), "SA1").alias("sa1_name"),
        sa2.alias("sa2_code"), K.sa_name(c("statistical_area_2"), "SA2").alias("sa2_name"),
        sa3.alias("sa3_code"), K.sa_name(sa3, "SA3").alias("sa3_name"),
        sa4.alias("sa4_code"), K.sa_name(sa4, "SA4").alias("sa4_name"),
        c("mesh_block_code").alias("mesh_block"),
        K.ccd_from_mesh_block(c("mesh_block_code")).alias("ccd"),
    )


@query("sa_codes", None)
def sa_codes(spark, sf):
    """X16 + X17: SA1-SA4 codes and names, mesh block and CCD for every address."""
    a = C.addresses(spark, sf).select("address_detail_pid", "statistical_area_2", "mesh_block_code")
    return _sa_columns(a, keep=["address_detail_pid"])


@query("sa_summary", None)
def sa_summary(spark, sf):
    """Per SA2/SA3/SA4 count and centroid of the distinct points (union removes duplicates)."""
    a = C.addresses(spark, sf).filter(F.col("statistical_area_2").isNotNull()).select(
        "statistical_area_2", K.sa3_from_sa2(F.col("statistical_area_2")).alias("statistical_area_3"),
        K.sa4_from_sa2(F.col("statistical_area_2")).alias("statistical_area_4"), "latitude", "longitude")
    keys = ["statistical_area_2", "statistical_area_3", "statistical_area_4"]
    pts = a.groupBy(*keys, "latitude", "longitude").agg(F.count(F.lit(1)).alias("n"))
    g = pts.groupBy(*keys).agg(F.sum("n").alias("address_count"), *_centroid_aggs())
    return g.select(*keys, "address_count", *_centroid_cols())


@query("locality_summary", None)
def locality_summary(spark, sf):
    """A12 (D11: locality columns via the locality table): count, mean confidence, centroid."""
    a = C.addresses(spark, sf).select("locality_pid", "confidence_score", "latitude", "longitude")
    loc = C.localities(spark, sf).select("locality_pid", "locality_name", "state_code", "postcode")
    j = a.join(loc, "locality_pid")
    keys = ["locality_pid", "locality_name", "state_code", "postcode"]
    pts = j.groupBy(*keys, "latitude", "longitude").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence_score").alias("conf_sum"))
    g = pts.groupBy(*keys).agg(
        F.sum("n").alias("address_count"), (F.sum("conf_sum") / F.sum("n")).alias("avg_confidence"),
        *_centroid_aggs())
    return g.select(*keys, "address_count", F.round("avg_confidence", 4).alias("avg_confidence"), *_centroid_cols())


HOTSPOT_MIN = 10


@query("density_hotspots", None)
def density_hotspots(spark, sf):
    """A13 + X12: 0.01-degree cells with more than 10 addresses; distinct locality names per cell.

    Names are de-duplicated per (cell, name) before the per-cell list, so the
    list is bounded by the locality dimension, not by the cell's row count.
    """
    a = C.addresses(spark, sf).select(
        G.snap_cell(F.col("longitude")).alias("cell_x"), G.snap_cell(F.col("latitude")).alias("cell_y"),
        "confidence_score", "locality_name")
    per_name = a.groupBy("cell_x", "cell_y", "locality_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence_score").alias("conf_sum"))
    g = per_name.groupBy("cell_x", "cell_y").agg(
        F.sum("n").alias("density"), (F.sum("conf_sum") / F.sum("n")).alias("avg_confidence"),
        F.array_join(F.array_sort(F.collect_list("locality_name")), "|").alias("localities"),
        F.count("locality_name").alias("n_localities"))
    return g.filter(F.col("density") > HOTSPOT_MIN).select(
        "cell_x", "cell_y", F.round(F.col("cell_x") * 0.01, 2).alias("grid_lon"),
        F.round(F.col("cell_y") * 0.01, 2).alias("grid_lat"), "density",
        F.round("avg_confidence", 4).alias("avg_confidence"), "localities", "n_localities")


@query("boundary_lookup", None)
def boundary_lookup(spark, sf):
    """J13 + X18: first polygon (by id) containing each request point."""
    polys = S.polygon_index(derived(spark, sf, "boundaries"))
    meta = derived(spark, sf, "boundaries").select("boundary_id", "locality_name", "state_code", "lga_name").distinct()
    req = normalised_requests(spark, sf).select("request_id", F.col("req_lon").alias("px"), F.col("req_lat").alias("py"))
    hits = S.contains_join(req, polys)
    first = S.top_k(hits.select("request_id", "boundary_id"), "request_id", [F.col("boundary_id")], 1)
    return first.join(meta, "boundary_id").select(
        "request_id", "boundary_id", "locality_name", "state_code", "lga_name",
        K.lga_category(F.col("lga_name")).alias("lga_category"))


@query("region_lookup", None)
def region_lookup(spark, sf):
    """Every overlapping, concave region that contains each request point."""
    req = normalised_requests(spark, sf).select("request_id", F.col("req_lon").alias("px"), F.col("req_lat").alias("py"))
    index = S.polygon_index(derived(spark, sf, "regions"), key="region_id")
    return S.contains_join(req, index).select("request_id", "region_id")


@query("lga_category", None)
def lga_category(spark, sf):
    """LGA category of every address's LGA name."""
    a = C.addresses(spark, sf)
    return a.groupBy("lga_name").agg(F.count(F.lit(1)).alias("n")).select(
        "lga_name", K.lga_category(F.col("lga_name")).alias("lga_category"), "n")


@query("delivery_office", None)
def delivery_office(spark, sf):
    """Delivery office from the postcode, per distinct postcode with its address count."""
    a = C.addresses(spark, sf).filter(F.col("postcode").isNotNull())
    return a.groupBy("postcode").agg(F.count(F.lit(1)).alias("n")).select(
        "postcode", K.delivery_office(F.col("postcode")).alias("delivery_office"), "n")


@query("haversine", None)
def haversine(spark, sf):
    """Great-circle distance from each request to its city centre (m 2 dp, km 2 dp)."""
    r = derived(spark, sf, "requests_point")
    cities = F.broadcast(derived(spark, sf, "cities").select(
        "city_id", F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon")))
    j = r.withColumn("city_id", (F.col("request_id") % 5).cast("int")).join(cities, "city_id")
    m = G.haversine_m(F.col("c_lat"), F.col("c_lon"), F.col("latitude"), F.col("longitude"))
    return j.select("request_id", "city_id", G.round_half_up(m, 2).alias("meters"),
                    (F.floor(m / 10 + 0.5) / 100).alias("kilometers"))


@query("bearing", None)
def bearing(spark, sf):
    """Initial bearing from each request's city centre to the request point, 2 dp."""
    r = derived(spark, sf, "requests_point")
    cities = F.broadcast(derived(spark, sf, "cities").select(
        "city_id", F.col("latitude").alias("c_lat"), F.col("longitude").alias("c_lon")))
    j = r.withColumn("city_id", (F.col("request_id") % 5).cast("int")).join(cities, "city_id")
    b = G.bearing_deg(F.col("c_lat"), F.col("c_lon"), F.col("latitude"), F.col("longitude"))
    return j.select("request_id", "city_id", G.round_half_up(b, 2).alias("bearing"))


@query("normalise_requests", None)
def normalise_requests(spark, sf):
    """P19 + X11: clamped proximity and reverse-geocode parameters, coordinates at 7 dp."""
    p = normalised_requests(spark, sf).select("request_id", "req_lat", "req_lon", "radius", "k")
    r = normalised_requests(spark, sf, REVERSE_RADIUS, REVERSE_LIMIT).select(
        "request_id", F.col("radius").alias("reverse_radius"), F.col("k").alias("reverse_k"))
    return p.join(r, "request_id")


# ------------------------------------------------------------------ oracles
from .registry import ORACLES  # noqa: E402

_OP = _o_req(PROXIMITY_RADIUS, PROXIMITY_LIMIT) + """,
ranked AS (SELECT *, CAST(round(distance_m) AS BIGINT) AS distance_meters,
                  row_number() OVER (PARTITION BY request_id ORDER BY round(distance_m), gnaf_pid) AS rnk
           FROM pairs)
"""
ORACLES["proximity"] = _OP + f"""
SELECT request_id, gnaf_pid, formatted_address AS address, latitude, longitude, distance_meters,
       round(CAST(distance_meters AS DOUBLE) / 1000 * 100) / 100 AS distance_km,
       {_BEARING_SQL} AS bearing, CAST(rnk AS BIGINT) AS rank
FROM ranked WHERE rnk <= k"""
ORACLES["proximity_summary"] = _OP + """
SELECT request_id, count(*) AS total, CAST(floor(avg(distance_meters) + 0.5) AS BIGINT) AS average_distance
FROM ranked WHERE rnk <= k GROUP BY request_id"""

_HAV = _haversine_sql("req_lat", "req_lon", "latitude", "longitude")
ORACLES["reverse_geocode"] = _o_req(REVERSE_RADIUS, REVERSE_LIMIT, where="address_status = 'CURRENT'") + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id
                                        ORDER BY round(distance_m, 4), coordinate_reliability, gnaf_pid) AS rnk
           FROM pairs)
SELECT request_id, gnaf_pid, formatted_address, number_first, street_name, street_type, locality_name, state_code,
       postcode, floor({_HAV} * 100 + 0.5) / 100 AS distance_m, floor({_HAV} / 10 + 0.5) / 100 AS distance_km,
       {_BEARING_SQL} AS bearing,
       CAST(CASE WHEN coordinate_reliability = 1 THEN 90 WHEN coordinate_reliability = 2 THEN 75 ELSE 60 END AS BIGINT)
         AS confidence,
       CAST(rnk AS BIGINT) AS rank
FROM ranked WHERE rnk <= k"""


def _sa_sql(mb="mesh_block_code", sa2="statistical_area_2"):
    def state(code):
        return (f"CASE substr({code}, 1, 1) WHEN '1' THEN 'NSW' WHEN '2' THEN 'VIC' WHEN '3' THEN 'QLD' WHEN '4' THEN 'SA' "
                f"WHEN '5' THEN 'WA' WHEN '6' THEN 'TAS' WHEN '7' THEN 'NT' WHEN '8' THEN 'ACT' ELSE 'AUS' END")

    def unknown(code):
        return f"({code} IS NULL OR {code} = '' OR {code} = 'Unknown')"

    sa3 = f"CASE WHEN {unknown(sa2)} THEN 'Unknown' WHEN length({sa2}) >= 5 THEN substr({sa2}, 1, 5) ELSE {sa2} END"
    sa4 = f"CASE WHEN {unknown(sa2)} THEN 'Unknown' WHEN length({sa2}) >= 3 THEN substr({sa2}, 1, 3) ELSE {sa2} END"
    sa1 = f"substr({mb}, 1, 11)"
    return f"""coalesce({sa1}, 'Unknown') AS sa1_code,
       CASE WHEN {unknown(sa1)} THEN 'Unknown SA1' ELSE 'SA1 ' || {sa1} END AS sa1_name,
       coalesce({sa2}, 'Unknown') AS sa2_code,
       CASE WHEN {unknown(sa2)} THEN 'Unknown SA2' ELSE 'SA2 ' || {sa2} END AS sa2_name,
       {sa3} AS sa3_code,
       CASE WHEN {unknown(sa3)} THEN 'Unknown SA3' ELSE {state(sa3)} || ' SA3 ' || ({sa3}) END AS sa3_name,
       {sa4} AS sa4_code,
       CASE WHEN {unknown(sa4)} THEN 'Unknown SA4' ELSE {state(sa4)} || ' SA4 ' || ({sa4}) END AS sa4_name,
       {mb} AS mesh_block,
       CASE WHEN {mb} IS NULL OR {mb} = '' THEN NULL WHEN length({mb}) >= 8 THEN substr({mb}, 1, 8) ELSE {mb} END AS ccd"""


ORACLES["statistical_area"] = _o_req(PROXIMITY_RADIUS, PROXIMITY_LIMIT, radius_sql="CAST(100 AS DOUBLE)") + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(distance_m, 4), gnaf_pid) AS rnk
           FROM pairs)
SELECT request_id, gnaf_pid, locality_pid, {_sa_sql()} FROM ranked WHERE rnk = 1"""
ORACLES["sa_codes"] = O + f"SELECT address_detail_pid, {_sa_sql()} FROM addresses"

_SA3 = ("CASE WHEN length(statistical_area_2) >= 5 THEN substr(statistical_area_2, 1, 5) ELSE statistical_area_2 END")
_SA4 = ("CASE WHEN length(statistical_area_2) >= 3 THEN substr(statistical_area_2, 1, 3) ELSE statistical_area_2 END")
ORACLES["sa_summary"] = O + f"""
, pts0 AS (SELECT statistical_area_2, {_SA3} AS statistical_area_3, {_SA4} AS statistical_area_4, latitude, longitude,
                  count(*) AS n
           FROM addresses WHERE statistical_area_2 IS NOT NULL GROUP BY 1, 2, 3, 4, 5)
SELECT statistical_area_2, statistical_area_3, statistical_area_4, CAST(sum(n) AS BIGINT) AS address_count,
       floor(CAST(sum(CAST(round(latitude * 10000000) AS BIGINT)) AS DOUBLE) / count(*)) / 10000000 AS center_lat,
       floor(CAST(sum(CAST(round(longitude * 10000000) AS BIGINT)) AS DOUBLE) / count(*)) / 10000000 AS center_lon
FROM pts0 GROUP BY 1, 2, 3"""
ORACLES["locality_summary"] = O + """
, pts0 AS (SELECT l.locality_pid, l.locality_name, l.state_code, l.postcode, a.latitude, a.longitude,
                  count(*) AS n, sum(a.confidence_score) AS conf_sum
           FROM addresses a JOIN localities l ON l.locality_pid = a.locality_pid GROUP BY 1, 2, 3, 4, 5, 6)
SELECT locality_pid, locality_name, state_code, postcode, CAST(sum(n) AS BIGINT) AS address_count,
       round(CAST(sum(conf_sum) AS DOUBLE) / sum(n), 4) AS avg_confidence,
       floor(CAST(sum(CAST(round(latitude * 10000000) AS BIGINT)) AS DOUBLE) / count(*)) / 10000000 AS center_lat,
       floor(CAST(sum(CAST(round(longitude * 10000000) AS BIGINT)) AS DOUBLE) / count(*)) / 10000000 AS center_lon
FROM pts0 GROUP BY 1, 2, 3, 4"""
ORACLES["density_hotspots"] = O + f"""
, cells AS (SELECT CAST(round(longitude / CAST(0.01 AS DOUBLE)) AS BIGINT) AS cell_x,
                   CAST(round(latitude / CAST(0.01 AS DOUBLE)) AS BIGINT) AS cell_y, confidence_score, locality_name
            FROM addresses),
per_name AS (SELECT cell_x, cell_y, locality_name, count(*) AS n, sum(confidence_score) AS conf_sum
             FROM cells GROUP BY 1, 2, 3)
SELECT cell_x, cell_y, round(cell_x * CAST(0.01 AS DOUBLE), 2) AS grid_lon,
       round(cell_y * CAST(0.01 AS DOUBLE), 2) AS grid_lat, CAST(sum(n) AS BIGINT) AS density,
       round(CAST(sum(conf_sum) AS DOUBLE) / sum(n), 4) AS avg_confidence,
       string_agg(locality_name, '|' ORDER BY locality_name) AS localities,
       count(locality_name) AS n_localities
FROM per_name GROUP BY 1, 2 HAVING sum(n) > {HOTSPOT_MIN}"""

_LGA_SQL = ("CASE WHEN lower(lga_name) LIKE '%city%' THEN 'City' WHEN lower(lga_name) LIKE '%shire%' THEN 'Shire' "
            "WHEN lower(lga_name) LIKE '%town%' THEN 'Town' WHEN lower(lga_name) LIKE '%borough%' THEN 'Borough' "
            "WHEN lower(lga_name) LIKE '%district%' THEN 'District' WHEN lower(lga_name) LIKE '%council%' THEN 'Council' "
            "WHEN lower(lga_name) LIKE '%regional%' THEN 'Regional' ELSE 'Council' END")
ORACLES["boundary_lookup"] = _o_req(PROXIMITY_RADIUS, PROXIMITY_LIMIT) + f""",
nv AS (SELECT boundary_id, count(*) AS n FROM boundaries GROUP BY 1),
edges AS (SELECT b.boundary_id, b.x AS x1, b.y AS y1, b2.x AS x2, b2.y AS y2
          FROM boundaries b JOIN nv ON nv.boundary_id = b.boundary_id
          JOIN boundaries b2 ON b2.boundary_id = b.boundary_id AND b2.vertex_no = (b.vertex_no + 1) % nv.n),
hits AS (SELECT r.request_id, e.boundary_id,
                sum(CASE WHEN (e.y1 > r.lat) <> (e.y2 > r.lat)
                          AND r.lon < (e.x2 - e.x1) * (r.lat - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) AS crossings
         FROM req r CROSS JOIN edges e GROUP BY 1, 2),
inside AS (SELECT request_id, min(boundary_id) AS boundary_id FROM hits WHERE crossings % 2 = 1 GROUP BY 1),
meta AS (SELECT DISTINCT boundary_id, locality_name, state_code, lga_name FROM boundaries)
SELECT i.request_id, i.boundary_id, m.locality_name, m.state_code, m.lga_name, {_LGA_SQL} AS lga_category
FROM inside i JOIN meta m ON m.boundary_id = i.boundary_id"""
ORACLES["region_lookup"] = _o_req(PROXIMITY_RADIUS, PROXIMITY_LIMIT) + """,
edges AS (SELECT region_id, x AS x1, y AS y1, coalesce(lead(x) OVER v, first_value(x) OVER v) AS x2,
                 coalesce(lead(y) OVER v, first_value(y) OVER v) AS y2 FROM regions WINDOW v AS (PARTITION BY region_id ORDER BY vertex_no))
SELECT r.request_id, e.region_id FROM req r CROSS JOIN edges e GROUP BY 1, 2
HAVING sum(CASE WHEN (e.y1 > r.lat) <> (e.y2 > r.lat)
                 AND r.lon < (e.x2 - e.x1) * (r.lat - e.y1) / (e.y2 - e.y1) + e.x1 THEN 1 ELSE 0 END) % 2 = 1"""
ORACLES["lga_category"] = O + f"SELECT lga_name, {_LGA_SQL} AS lga_category, count(*) AS n FROM addresses GROUP BY lga_name"
ORACLES["delivery_office"] = O + """SELECT postcode,
  CASE WHEN TRY_CAST(postcode AS INTEGER) BETWEEN 1000 AND 2999 THEN 'NSW'
       WHEN TRY_CAST(postcode AS INTEGER) BETWEEN 3000 AND 3999 THEN 'VIC'
       WHEN TRY_CAST(postcode AS INTEGER) BETWEEN 4000 AND 4999 THEN 'QLD'
       WHEN TRY_CAST(postcode AS INTEGER) BETWEEN 5000 AND 5999 THEN 'SA'
       WHEN TRY_CAST(postcode AS INTEGER) BETWEEN 6000 AND 6999 THEN 'WA'
       WHEN TRY_CAST(postcode AS INTEGER) BETWEEN 7000 AND 7999 THEN 'TAS'
       WHEN TRY_CAST(postcode AS INTEGER) BETWEEN 800 AND 899 THEN 'NT'
       WHEN TRY_CAST(postcode AS INTEGER) BETWEEN 200 AND 299 THEN 'ACT' ELSE 'Unknown' END AS delivery_office,
  count(*) AS n
FROM addresses WHERE postcode IS NOT NULL GROUP BY postcode"""

_CITY_JOIN = C.register_sql("requests_point", "cities") + """,
rc AS (SELECT r.request_id, c.city_id, c.latitude AS c_lat, c.longitude AS c_lon, r.latitude, r.longitude
       FROM requests_point r JOIN cities c ON c.city_id = r.request_id % 5)
"""
_HAV_C = _haversine_sql("c_lat", "c_lon", "latitude", "longitude")
ORACLES["haversine"] = _CITY_JOIN + f"""SELECT request_id, CAST(city_id AS BIGINT) AS city_id,
  floor({_HAV_C} * 100 + 0.5) / 100 AS meters, floor({_HAV_C} / 10 + 0.5) / 100 AS kilometers FROM rc"""
ORACLES["bearing"] = _CITY_JOIN + "SELECT request_id, CAST(city_id AS BIGINT) AS city_id, " + _BEARING_SQL.replace(
    "req_lat", "c_lat").replace("req_lon", "c_lon") + " AS bearing FROM rc"
ORACLES["normalise_requests"] = C.register_sql("requests_point") + f"""
SELECT request_id, round(latitude, 7) AS req_lat, round(longitude, 7) AS req_lon,
       CAST({_sql_clamp('radius', PROXIMITY_RADIUS)} AS BIGINT) AS radius,
       CAST({_sql_clamp('max_results', PROXIMITY_LIMIT)} AS BIGINT) AS k,
       CAST({_sql_clamp('radius', REVERSE_RADIUS)} AS BIGINT) AS reverse_radius,
       CAST({_sql_clamp('max_results', REVERSE_LIMIT)} AS BIGINT) AS reverse_k
FROM requests_point"""
