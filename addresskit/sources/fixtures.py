"""Register-shaped tables derived from the driver's test tables.

The reference ships no data. The tables below give the same shapes (raw
locality / street / geocode / address-detail files, request tables, boundary
polygons and request logs) and are computed from ``/root/testdata`` with one
SQL text that Spark and the DuckDB oracle both run, so both engines see
identical inputs. Each template names its inputs as ``{table}`` placeholders:
Spark binds DataFrames to them (``spark.sql(sql, **frames)``), the oracle binds
CTE names. The library code under ``operators``/``plans`` is DataFrame code and
never reads these templates.

Portability rules: cast to DOUBLE before dividing, ``%`` only on non-negative
integers, ``CAST(floor(x) AS BIGINT)`` for integer conversion (DuckDB's CAST
rounds, Spark's truncates), no decimal literals in arithmetic without a cast.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

RAW_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# The five probe cities of the reference benchmark, in its order
# (Melbourne, Sydney, Brisbane, Perth, Adelaide) with their centre coordinates.
CITIES = [
    (0, "MELBOURNE", "VIC", -37.8136, 144.9631),
    (1, "SYDNEY", "NSW", -33.8688, 151.2093),
    (2, "BRISBANE", "QLD", -27.4698, 153.0251),
    (3, "PERTH", "WA", -31.9505, 115.8605),
    (4, "ADELAIDE", "SA", -34.9285, 138.6007),
]


def _city_case(key: str, field: int) -> str:
    parts = " ".join(
        f"WHEN {c[0]} THEN CAST({c[field]} AS DOUBLE)" for c in CITIES
    )
    return f"CASE {key} % 5 {parts} END"


_CITY_ROWS = ", ".join(
    f"({c[0]}, '{c[1]}', '{c[2]}', CAST({c[3]} AS DOUBLE), CAST({c[4]} AS DOUBLE))" for c in CITIES
)

# name -> (sql template, inputs). Inputs are raw table names or other entries.
DERIVED: dict[str, tuple[str, tuple[str, ...]]] = {
    "cities": (
        f"SELECT * FROM (VALUES {_CITY_ROWS}) AS t(city_id, city_name, state_code, latitude, longitude)",
        (),
    ),
    # *_LOCALITY_* file
    "loc_raw": (
        """
        SELECT 'L' || CAST(c_custkey AS STRING) AS locality_pid,
               CASE WHEN c_custkey % 89 = 0 THEN NULL
                    ELSE upper(c_mktsegment || ' ' || CAST(c_custkey % 40 AS STRING)) END AS locality_name,
               CASE WHEN c_custkey % 7 = 0 THEN 'G' END AS locality_class_code,
               CAST(c_nationkey % 11 AS STRING) AS state_pid,
               CASE WHEN c_custkey % 13 = 0 THEN NULL
                    ELSE CAST(2000 + c_custkey % 6000 AS STRING) END AS primary_postcode
        FROM {customer}
        """,
        ("customer",),
    ),
    # *_STREET_LOCALITY_* file
    "streets_raw": (
        """
        SELECT 'S' || CAST(p_partkey AS STRING) AS street_locality_pid,
               upper(p_name) AS street_name,
               CASE p_size % 5 WHEN 0 THEN 'ST' WHEN 1 THEN 'RD' WHEN 2 THEN 'AVE' WHEN 3 THEN 'LN' END
                   AS street_type_code,
               CAST(NULL AS STRING) AS street_suffix_code,
               'L' || CAST(p_partkey % (SELECT count(*) FROM {customer}) AS STRING) AS locality_pid
        FROM {part}
        """,
        ("part", "customer"),
    ),
    # *_ADDRESS_DEFAULT_GEOCODE_* file
    "geocodes_raw": (
        f"""
        SELECT 'GA' || CAST(o_orderkey AS STRING) AS address_detail_pid,
               CASE WHEN o_orderkey % 97 = 0 THEN CAST(-60 AS DOUBLE)
                    ELSE {_city_case('o_orderkey', 3)}
                         + CAST((o_orderkey * 7919) % 1000 - 500 AS DOUBLE) / 10000 END AS latitude,
               {_city_case('o_orderkey', 4)}
                   + CAST((o_orderkey * 6007) % 1009 - 504 AS DOUBLE) / 10000 AS longitude,
               CASE o_orderkey % 4 WHEN 0 THEN 'PROPERTY CENTROID' WHEN 1 THEN 'STREET LOCALITY'
                    WHEN 2 THEN 'LOCALITY' ELSE 'GAP' END AS geocode_type_code,
               1 AS load_seq
        FROM {{orders}}
        WHERE o_orderkey % 53 <> 0
        UNION ALL
        SELECT 'GA' || CAST(o_orderkey AS STRING) AS address_detail_pid, CAST(-11 AS DOUBLE) AS latitude,
               CAST(153 AS DOUBLE) AS longitude, 'PROPERTY CENTROID' AS geocode_type_code, 0 AS load_seq
        FROM {{orders}}
        WHERE o_orderkey % 41 = 0 AND o_orderkey % 53 <> 0
        """,
        ("orders",),
    ),
    # *_ADDRESS_DETAIL_* file
    "address_detail": (
        """
        SELECT 'GA' || CAST(o_orderkey AS STRING) AS address_detail_pid,
               CAST(NULL AS STRING) AS gnaf_pid,
               CASE WHEN o_orderkey % 11 = 0 THEN 'BLDG ' || CAST(o_custkey % 100 AS STRING) END AS building_name,
               CAST(NULL AS STRING) AS lot_number,
               CASE WHEN o_orderkey % 6 = 0 THEN 'UNIT' END AS flat_type_code,
               CASE WHEN o_orderkey % 6 = 0 THEN CAST(1 + o_orderkey % 30 AS STRING) END AS flat_number,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(1 + o_custkey % 200 AS STRING) END AS number_first,
               CAST(NULL AS STRING) AS number_last,
               CASE WHEN o_orderkey % 17 = 0 THEN NULL
                    WHEN o_orderkey % 101 = 0 THEN 'SX' || CAST(o_custkey % (SELECT count(*) FROM {part}) AS STRING)
                    ELSE 'S' || CAST(o_custkey % (SELECT count(*) FROM {part}) AS STRING) END AS street_locality_pid,
               'L' || CAST(o_custkey AS STRING) AS locality_pid,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(2000 + o_custkey % 6000 AS STRING) END AS postcode,
               CASE o_orderkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' END AS reliability,
               CAST(NULL AS STRING) AS legal_parcel_id,
               'LGA' || CAST(o_custkey % 50 AS STRING) AS lga_code,
               CASE o_custkey % 6 WHEN 0 THEN 'CITY OF ' WHEN 1 THEN 'SHIRE OF ' WHEN 2 THEN 'TOWN OF '
                    WHEN 3 THEN 'REGIONAL COUNCIL OF ' WHEN 4 THEN 'DISTRICT ' ELSE 'AREA ' END
                   || CAST(o_custkey % 50 AS STRING) AS lga_name,
               CASE WHEN o_orderstatus = 'P' THEN 'RETIRED' ELSE 'CURRENT' END AS address_status,
               CAST(o_orderdate AS DATE) AS date_created,
               CAST(1 + o_orderkey % 8 AS STRING) || lpad(CAST(o_custkey % 100000000 AS STRING), 8, '0')
                   AS statistical_area_2,
               CAST(1 + o_orderkey % 8 AS STRING) || lpad(CAST(o_custkey % 100000000 AS STRING), 8, '0')
                   || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') AS mesh_block_code,
               CAST(year(o_orderdate) AS STRING) AS import_batch_id
        FROM {orders}
        """,
        ("orders", "part"),
    ),
    # parser-variant records (39-column layout: prefixes, suffixes, state abbreviation, lifecycle text)
    "parser_records": (
        f"""
        SELECT 'GA' || CAST(o.o_orderkey AS STRING) AS address_detail_pid,
               CASE WHEN o.o_orderkey % 6 = 0 THEN 'UNIT' END AS flat_type,
               CASE WHEN o.o_orderkey % 12 = 0 THEN 'F' END AS flat_number_prefix,
               CASE WHEN o.o_orderkey % 6 = 0 THEN CAST(1 + o.o_orderkey % 30 AS STRING) END AS flat_number,
               CASE WHEN o.o_orderkey % 18 = 0 THEN 'B' END AS flat_number_suffix,
               CASE WHEN o.o_orderkey % 11 = 0 THEN 'BLDG ' || CAST(o.o_custkey % 100 AS STRING) END AS building_name,
               CASE WHEN o.o_orderkey % 15 = 0 THEN 'LOT' END AS lot_number_prefix,
               CASE WHEN o.o_orderkey % 5 = 0 THEN CAST(o.o_orderkey % 900 AS STRING) END AS lot_number,
               CAST(NULL AS STRING) AS lot_number_suffix,
               CASE WHEN o.o_orderkey % 9 = 0 THEN 'RMB' END AS number_first_prefix,
               CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE CAST(1 + o.o_custkey % 200 AS STRING) END AS number_first,
               CASE WHEN o.o_orderkey % 8 = 0 THEN 'A' END AS number_first_suffix,
               CASE WHEN o.o_orderkey % 19 = 0 THEN NULL ELSE upper(p.p_name) END AS street_name,
               CASE p.p_size % 5 WHEN 0 THEN 'ST' WHEN 1 THEN 'RD' WHEN 2 THEN 'AVE' WHEN 3 THEN 'LN' END
                   AS street_type_code,
               CASE WHEN o.o_orderkey % 23 = 0 THEN 'N' END AS street_suffix_code,
               CASE WHEN c.c_custkey % 89 = 0 THEN NULL
                    ELSE upper(c.c_mktsegment || ' ' || CAST(c.c_custkey % 40 AS STRING))
                         || CASE c.c_custkey % 10 WHEN 0 THEN ' CITY' WHEN 1 THEN ' TOWN' ELSE '' END END
                   AS locality_name,
               CASE c.c_nationkey % 10 WHEN 0 THEN 'nsw' WHEN 1 THEN 'VIC' WHEN 2 THEN 'QLD' WHEN 3 THEN 'SA'
                    WHEN 4 THEN 'WA' WHEN 5 THEN 'Tas' WHEN 6 THEN 'NT' WHEN 7 THEN 'ACT' WHEN 8 THEN 'XX' END
                   AS state_abbreviation,
               CASE WHEN o.o_orderkey % 10 = 0 THEN NULL
                    ELSE CAST(CASE c.c_nationkey % 10 WHEN 1 THEN 3000 WHEN 2 THEN 4000 WHEN 3 THEN 5000
                                   WHEN 4 THEN 6000 WHEN 5 THEN 7000 WHEN 6 THEN 800 WHEN 7 THEN 2600
                                   ELSE 2000 END + o.o_custkey % 700 AS STRING) END AS postcode,
               CASE WHEN o.o_orderkey % 97 = 0 THEN CAST(-60 AS DOUBLE)
                    ELSE {_city_case('o.o_orderkey', 3)}
                         + CAST((o.o_orderkey * 7919) % 1000 - 500 AS DOUBLE) / 10000 END AS latitude,
               {_city_case('o.o_orderkey', 4)}
                   + CAST((o.o_orderkey * 6007) % 1009 - 504 AS DOUBLE) / 10000 AS longitude,
               CASE o.o_orderkey % 5 WHEN 0 THEN 'PROPERTY CENTROID' WHEN 1 THEN 'BUILDING CENTROID'
                    WHEN 2 THEN 'STREET LOCALITY' WHEN 3 THEN 'LOCALITY' END AS geocode_type,
               CASE o.o_orderkey % 5 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' WHEN 3 THEN '4' END
                   AS reliability,
               CASE o.o_orderstatus WHEN 'P' THEN 'Retired' WHEN 'O' THEN 'proposed' ELSE 'Current' END
                   AS address_status,
               CASE WHEN o.o_orderkey % 4 = 0 THEN 'LP' || CAST(o.o_orderkey AS STRING) END AS legal_parcel_id
        FROM {{orders}} o
        JOIN {{customer}} c ON c.c_custkey = o.o_custkey
        LEFT JOIN {{part}} p ON p.p_partkey = o.o_custkey % (SELECT count(*) FROM {{part}})
        """,
        ("orders", "customer", "part"),
    ),
    # a second locality delivery: changed rows for a quarter of the keys plus new keys
    "loc_update": (
        """
        SELECT CASE WHEN c_custkey % 50 = 0 THEN 'LN' ELSE 'L' END || CAST(c_custkey AS STRING) AS locality_pid,
               upper(c_mktsegment || ' ' || CAST(c_custkey % 40 AS STRING)) || ' NORTH' AS locality_name,
               'C' AS locality_class_code,
               CAST(1 + c_custkey % 9 AS STRING) AS state_pid,
               CAST(3000 + c_custkey % 900 AS STRING) AS primary_postcode
        FROM {customer}
        WHERE c_custkey % 4 = 0 OR c_custkey % 50 = 0
        """,
        ("customer",),
    ),
    # a second street delivery
    "streets_update": (
        """
        SELECT CASE WHEN p_partkey % 45 = 0 THEN 'SN' ELSE 'S' END || CAST(p_partkey AS STRING) AS street_locality_pid,
               upper(p_name) || ' EAST' AS street_name,
               'CT' AS street_type_code,
               'E' AS street_suffix_code,
               'L' || CAST((p_partkey + 1) % (SELECT count(*) FROM {customer}) AS STRING) AS locality_pid
        FROM {part}
        WHERE p_partkey % 3 = 0 OR p_partkey % 45 = 0
        """,
        ("part", "customer"),
    ),
    # one proximity request per customer, near one of the five cities
    "requests_point": (
        f"""
        SELECT c_custkey AS request_id,
               {_city_case('c_custkey', 3)} + CAST((c_custkey * 4019) % 1000 - 500 AS DOUBLE) / 10000 AS latitude,
               {_city_case('c_custkey', 4)} + CAST((c_custkey * 3001) % 1009 - 504 AS DOUBLE) / 10000 AS longitude,
               CAST(CASE c_custkey % 3 WHEN 0 THEN 500 WHEN 1 THEN 1000 ELSE 2000 END AS BIGINT) AS radius,
               CAST(10 AS BIGINT) AS max_results
        FROM {{customer}}
        """,
        ("customer",),
    ),
    # mixed spatial batch operations (some invalid), 50 operations per batch
    "api_requests": (
        f"""
        SELECT c.c_custkey AS request_id,
               CAST(floor(CAST(c_custkey AS DOUBLE) / 50) AS BIGINT) AS batch_id,
               CASE c_custkey % 7 WHEN 3 THEN 'boundary' WHEN 4 THEN 'boundary' WHEN 5 THEN 'statistical'
                    WHEN 6 THEN CASE WHEN c_custkey % 14 = 6 THEN 'isochrone' ELSE 'proximity' END
                    ELSE 'proximity' END AS op_type,
               CASE WHEN c_custkey % 23 = 0 THEN NULL
                    WHEN c_custkey % 29 = 0 THEN CAST(-60 AS DOUBLE)
                    WHEN c_custkey % 31 = 0 THEN CAST('NaN' AS DOUBLE)
                    ELSE {_city_case('c_custkey', 3)} + CAST((c_custkey * 4019) % 1000 - 500 AS DOUBLE) / 10000 END
                   AS latitude,
               CASE WHEN c_custkey % 23 = 0 THEN NULL
                    ELSE {_city_case('c_custkey', 4)} + CAST((c_custkey * 3001) % 1009 - 504 AS DOUBLE) / 10000 END
                   AS longitude,
               CASE WHEN c_custkey % 46 = 0 THEN 'xy' WHEN c_custkey % 23 = 0 AND c_custkey % 3 > 0 THEN r.address_text
                    WHEN c_custkey % 47 = 0 THEN r.address_text END AS address,
               CAST(CASE WHEN c_custkey % 37 = 0 THEN 0 WHEN c_custkey % 41 = 0 THEN 9000
                         WHEN c_custkey % 3 = 0 THEN 500 WHEN c_custkey % 3 = 1 THEN 1000 ELSE 2000 END AS BIGINT)
                   AS radius,
               CAST(CASE WHEN c_custkey % 43 = 0 THEN 100 ELSE 10 END AS BIGINT) AS max_results
        FROM {{customer}} c JOIN {{requests_text}} r ON r.request_id = c.c_custkey
        """,
        ("customer", "requests_text"),
    ),
    # user-supplied CIDR ranges for IP enrichment: one /24 per nation plus a covering /16
    "ip_ranges": (
        """
        SELECT '10.0.' || CAST(n_nationkey AS STRING) || '.0/24' AS cidr, n_name AS country
        FROM {nation}
        UNION ALL
        SELECT '10.0.0.0/16', 'PRIVATE'
        UNION ALL SELECT '0.0.0.0/0', 'ANYWHERE'
        UNION ALL SELECT '10.0.0.0/8', 'TEN'
        UNION ALL SELECT '10.0.0.5/32', 'HOST'
        """,
        ("nation",),
    ),
    # one free-text address request per customer
    "requests_text": (
        """
        WITH base AS (
          SELECT c.c_custkey AS request_id,
                 CAST(1 + c.c_custkey % 200 AS STRING) AS num,
                 s.street_name AS street_name, s.street_type_code AS street_type,
                 upper(c.c_mktsegment || ' ' || CAST(c.c_custkey % 40 AS STRING)) AS locality,
                 concat_ws(' ', s.street_name, s.street_type_code,
                           upper(c.c_mktsegment || ' ' || CAST(c.c_custkey % 40 AS STRING)),
                           CASE CAST(c.c_nationkey % 11 AS STRING)
                                WHEN '1' THEN 'NSW' WHEN '2' THEN 'VIC' WHEN '3' THEN 'QLD' WHEN '4' THEN 'SA'
                                WHEN '5' THEN 'WA' WHEN '6' THEN 'TAS' WHEN '7' THEN 'NT' WHEN '8' THEN 'ACT'
                                WHEN '9' THEN 'OT' END,
                           CASE WHEN c.c_custkey % 13 = 0 THEN NULL
                                ELSE CAST(2000 + c.c_custkey % 6000 AS STRING) END) AS rest
          FROM {customer} c
          LEFT JOIN {streets_raw} s
            ON s.street_locality_pid = 'S' || CAST(c.c_custkey % (SELECT count(*) FROM {part}) AS STRING)
        )
        SELECT request_id,
               CASE request_id % 4
                    WHEN 0 THEN num || ' ' || rest
                    WHEN 1 THEN rest
                    WHEN 2 THEN '  ' || num || '  ' || rest || '.'
                    ELSE CASE WHEN request_id % 8 = 3 THEN 'xyzzy ' || CAST(request_id AS STRING) || ' plugh nowhere'
                              ELSE num || ' ' || coalesce(split_part(street_name, ' ', 1), 'MAIN') || ' ' || coalesce(street_type, 'ST')
                                   || ' ' || locality END END AS address_text,
               CASE WHEN request_id % 7 = 0 THEN 'vic' END AS state_filter,
               CASE request_id % 5 WHEN 1 THEN 1 WHEN 2 THEN 50 WHEN 3 THEN 500 WHEN 4 THEN 3 END AS max_results,
               CASE WHEN request_id % 11 = 0 THEN CAST(2000 + request_id % 6000 AS STRING) END AS postcode_filter
        FROM base
        """,
        ("customer", "streets_raw", "part"),
    ),
    # JSON bodies of requests, one of a list of cases a customer: right ones, and each rule broken
    "api_bodies": (
        """
        WITH cases AS (SELECT * FROM (VALUES
          (0, 'proximity', '{{"coordinates":{{"latitude":-33.8,"longitude":151.2}},"radius":500,"limit":5}}'),
          (1, 'proximity', '{{}}'), (2, 'proximity', '{{"coordinates":null,"address":""}}'),
          (3, 'proximity', '{{"coordinates":{{"latitude":"-33.8","longitude":151.2}}}}'),
          (4, 'proximity', '{{"coordinates":{{"latitude":-33.8}}}}'), (5, 'proximity', '{{"coordinates":{{"latitude":-50,"longitude":151.2}}}}'),
          (6, 'proximity', '{{"address":"ab "}}'), (7, 'proximity', '{{"address":42}}'),
          (8, 'proximity', '{{"address":"1 main street","radius":0}}'), (9, 'proximity', '{{"address":"1 main street","radius":2.5}}'),
          (10, 'proximity', '{{"address":"1 main street","radius":null}}'), (11, 'proximity', '{{"address":"1 main street","radius":5000.0,"limit":51}}'),
          (12, 'proximity', '{{"address":"1 main street","propertyTypes":["a",1]}}'), (13, 'proximity', '{{"address":"1 main street","propertyTypes":"a"}}'),
          (14, 'proximity', '{{"address":"1 main street","propertyTypes":[],"includeDistance":"yes"}}'),
          (15, 'proximity', '{{"address":"1 main street","includeBearing":1}}'), (16, 'proximity', 'no json'),
          (17, 'boundary', '{{"coordinates":{{"latitude":-33.8,"longitude":151.2}},"includeLGA":false}}'), (18, 'boundary', '{{"address":"x"}}'),
          (19, 'boundary', '{{"coordinates":{{}}}}'), (20, 'boundary', '{{"coordinates":{{"latitude":-33.8,"longitude":160}}}}'),
          (21, 'boundary', '{{"coordinates":{{"latitude":-33.8,"longitude":151.2}},"includeElectoral":"no"}}'),
          (22, 'boundary', '{{"coordinates":{{"latitude":-33.8,"longitude":151.2}},"includePostal":null}}'),
          (23, 'statistical', '{{"address":"1 main street","includeHierarchy":true}}'), (24, 'statistical', '{{"includeHierarchy":true}}'),
          (25, 'statistical', '{{"coordinates":{{"latitude":1e400,"longitude":151.2}}}}'), (26, 'statistical', '{{"coordinates":{{"latitude":-8,"longitude":151.2}}}}'),
          (27, 'statistical', '{{"address":"  a"}}'), (28, 'statistical', '{{"address":"abc","includeHierarchy":"true"}}'),
          (29, 'batch', '{{"operations":[{{"id":"a","type":"proximity","parameters":{{}}}}],"options":{{"batchSize":10,"failFast":true}}}}'),
          (30, 'batch', '{{"operations":[]}}'), (31, 'batch', '{{"operations":{{}}}}'),
          (32, 'batch', '{{"operations":[{{"id":"a","type":"proximity","parameters":{{}}}},{{"id":7,"type":"x"}}]}}'),
          (33, 'batch', '{{"operations":[{{"id":"a","type":"isochrone","parameters":{{}}}}]}}'),
          (34, 'batch', '{{"operations":[{{"id":"a","type":"boundary"}},{{"id":""}}]}}'), (35, 'batch', '{{"operations":[{{"id":"","type":"boundary"}}]}}'),
          (36, 'batch', '{{"operations":[{{"id":"a","type":"boundary","parameters":{{}}}}],"options":{{"batchSize":1.5}}}}'),
          (37, 'batch', '{{"operations":[{{"id":"a","type":"boundary","parameters":[]}}],"options":{{"progressCallback":null}}}}'),
          (38, 'batch', '{{"operations":[{{"id":"a","type":"boundary","parameters":{{}}}}],"options":{{"batchSize":0,"failFast":"x"}}}}'),
          (39, 'search', '{{"q":" ","limit":5}}'), (40, 'search', '{{"q":"main","limit":51}}'), (41, 'search', '{{"q":"main","limit":0}}'), (42, 'search', '{{}}'),
          (43, 'validate', '{{"address":""}}'), (44, 'validate', '{{"address":["x"]}}'), (45, 'validate', '{{"address":"LONG"}}'), (46, 'validate', '{{"address":"1 main street"}}'),
          (47, 'geocode', '{{"address":"1 main street","coordinateSystem":"AGD66"}}'), (48, 'geocode', '{{"address":"1 main street","coordinateSystem":""}}'),
          (49, 'geocode', '{{"coordinateSystem":"WGS84"}}'), (50, 'geocode', '{{"address":"LONG","coordinateSystem":"x"}}'),
          (51, 'reverse', '{{"latitude":-33.8,"longitude":151.2,"radius":1000,"limit":10}}'), (52, 'reverse', '{{"latitude":"x","longitude":151.2}}'),
          (53, 'reverse', '{{"latitude":-91,"longitude":151.2}}'), (54, 'reverse', '{{"latitude":-33.8,"longitude":181}}'),
          (55, 'reverse', '{{"latitude":-33.8,"longitude":151.2,"coordinateSystem":"x"}}'), (56, 'reverse', '{{"latitude":-33.8,"longitude":151.2,"radius":1001}}'),
          (57, 'reverse', '{{"latitude":-33.8,"longitude":151.2,"radius":0,"limit":11}}'), (58, 'batch', '{{"operations":MANY}}')
          ) AS t(case_no, kind, body))
        SELECT c.c_custkey AS request_id, k.case_no, k.kind,
               replace(replace(k.body, 'LONG', repeat('1 main street ', 36)), 'MANY',
                       '[' || repeat('{{"id":"a","type":"boundary","parameters":{{}}}},', 100) || '{{"id":"a","type":"boundary","parameters":{{}}}}]') AS body
        FROM {customer} c JOIN cases k ON k.case_no = c.c_custkey % 59
        """,
        ("customer",),
    ),
    # five cities x four quadrants; each polygon is a ring of 4 corners (long form)
    "boundaries": (
        """
        SELECT c.city_name || '-' || q.quadrant AS boundary_id,
               c.city_name AS locality_name,
               c.state_code AS state_code,
               'CITY OF ' || c.city_name AS lga_name,
               v.vertex_no AS vertex_no,
               c.longitude + CAST(q.dx * v.ux AS DOUBLE) / 20 AS x,
               c.latitude + CAST(q.dy * v.uy AS DOUBLE) / 20 AS y
        FROM {cities} c
        CROSS JOIN (VALUES ('NE', 1, 1), ('NW', -1, 1), ('SW', -1, -1), ('SE', 1, -1)) AS q(quadrant, dx, dy)
        CROSS JOIN (VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1)) AS v(vertex_no, ux, uy)
        """,
        ("cities",),
    ),
    # three overlapping comb-shaped regions a city, 202 vertices each
    "regions": (
        """
        WITH k AS (SELECT city_id, latitude, longitude, {numbers} AS k FROM {cities}),
        r AS (SELECT k.*, s.shift FROM k CROSS JOIN (VALUES (0), (1), (2)) AS s(shift) WHERE k.k < 202)
        SELECT 'R' || CAST(city_id AS STRING) || '-' || CAST(shift AS STRING) AS region_id, k AS vertex_no,
               longitude + CAST(shift * 30 AS DOUBLE) / 1000
                 + CASE WHEN k < 200 THEN CAST(k * 8 - 800 AS DOUBLE) / 10000 WHEN k = 200 THEN CAST(8 AS DOUBLE) / 100
                        ELSE CAST(-8 AS DOUBLE) / 100 END AS x,
               latitude + CAST(shift * 20 AS DOUBLE) / 1000
                 + CASE WHEN k >= 200 THEN CAST(-7 AS DOUBLE) / 100 WHEN k % 2 = 0 THEN CAST(7 AS DOUBLE) / 100
                        ELSE CAST(5 * (k % 7) - 20 AS DOUBLE) / 1000 END AS y
        FROM r
        """,
        ("cities",),
    ),
    # API request log, one row per event
    "request_log": (
        """
        SELECT event_id AS request_id,
               ts,
               CASE event_type
                    WHEN 'view' THEN CASE WHEN event_id % 7 = 0 THEN '/api/v1/addresses/GA' || CAST(event_id AS STRING)
                                          ELSE '/api/v1/addresses/search' END
                    WHEN 'click' THEN '/api/v1/addresses/validate'
                    WHEN 'signup' THEN '/api/v1/addresses/geocode'
                    WHEN 'purchase' THEN '/api/v1/spatial/proximity'
                    ELSE CASE WHEN event_id % 2 = 0 THEN '/api/v1/addresses/validate'
                              ELSE '/api/v1/health/detailed' END END AS path,
               CASE WHEN event_type IN ('view', 'error') AND event_id % 2 = 1 THEN 'GET' ELSE 'POST' END AS method,
               CAST(CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 500 ELSE 404 END
                         ELSE 200 END AS BIGINT) AS status_code,
               CAST(floor(value * 10) AS BIGINT) AS duration_ms,
               user_id AS client,
               '10.0.' || CAST(CAST(floor(CAST(user_id AS DOUBLE) / 256) AS BIGINT) AS STRING) || '.'
                   || CAST(user_id % 256 AS STRING) AS ip,
               event_id % 3 = 0 AS cache_hit,
               CASE WHEN event_id % 3 = 0 THEN 'l1' WHEN event_id % 5 = 0 THEN 'l2' ELSE 'miss' END AS cache_layer,
               CAST(floor(value * 5000) AS BIGINT) AS response_bytes,
               CASE WHEN event_id % 97 = 0 THEN 'q=1 UNION SELECT password FROM users'
                    WHEN event_id % 89 = 0 THEN 'q=<script>alert(1)</script>'
                    WHEN event_id % 83 = 0 THEN 'next=javascript:alert(1)'
                    WHEN event_id % 79 = 0 THEN 'x=1 onload = steal()'
                    ELSE 'q=' || props END AS query_text,
               event_type
        FROM {events}
        """,
        ("events",),
    ),
    # the request log with bursts in it: forbidden and rate-limited requests, errors, slow calls, attacks in the query,
    # the body and the proxy header
    "burst_log": (
        """
        WITH n AS (
          SELECT event_id, ts, user_id, {numbers} AS k FROM {events} WHERE event_id % 5000 = 7
        ),
        b AS (
          SELECT 1 AS kind, event_id, ts, user_id, k, k * 150000 AS off_us FROM n
          UNION ALL SELECT 2, event_id, ts, user_id, k, k * 900000 FROM n WHERE k < 400
          UNION ALL SELECT 3, event_id, ts, user_id, k, CAST(3600000000 AS BIGINT) + k * 20000000 FROM n WHERE k < 24
          UNION ALL SELECT 4, event_id, ts, user_id, k, CAST(7200000000 AS BIGINT) + k * 60000000 FROM n WHERE k < 12
          UNION ALL SELECT 5, event_id, ts, user_id, k, CAST(10800000000 AS BIGINT) + k * 7000000 FROM n WHERE k < 20
        )
        SELECT request_id, ts, path, method, status_code, duration_ms, client, ip, cache_hit, query_text,
               CAST(NULL AS STRING) AS body_text, CAST(NULL AS STRING) AS forwarded_for,
               CASE status_code WHEN 500 THEN 'InternalError' WHEN 404 THEN 'NotFoundError' END AS error_name
        FROM {request_log}
        UNION ALL
        SELECT 1000000000 + event_id * 100000 + kind * 10000 + k, {shift},
               CASE WHEN k % 5 = 0 THEN '/api/v1/spatial/proximity' WHEN k % 5 < 3 THEN '/api/v1/addresses/search'
                    ELSE '/api/v1/addresses/validate' END,
               'GET', CAST(CASE kind WHEN 1 THEN 403 WHEN 2 THEN 429 WHEN 3 THEN CASE WHEN k % 2 = 0 THEN 500 ELSE 404 END
                                     ELSE 200 END AS BIGINT),
               CAST(CASE kind WHEN 4 THEN 1000 + k * 250 ELSE 20 END AS BIGINT), user_id,
               '10.9.0.' || CAST((k + event_id) % 13 AS STRING), k % 2 = 0,
               CASE WHEN kind = 5 AND k % 4 = 0 THEN 'q=1 UNION SELECT 2' ELSE 'q=street' END,
               CASE WHEN kind = 5 AND k % 4 = 1 THEN '{{"address":"<script>alert(1)</script>"}}' WHEN kind = 5 AND k % 4 = 3 THEN '{{}}' END,
               CASE WHEN kind = 5 AND k % 4 = 2 THEN '10.0.0.1/../1' WHEN k % 3 = 0 THEN '10.0.0.1' END,
               CASE WHEN kind = 3 THEN CASE WHEN k % 3 = 0 THEN 'TimeoutError' WHEN k % 3 = 1 THEN 'InternalError'
                                            ELSE 'ValidationError' END END
        FROM b
        """,
        ("events", "request_log"),
    ),
    # per-minute cumulative request counter, reset at the start of each day
    "counters": (
        """
        WITH m AS (
          SELECT date_trunc('minute', ts) AS minute, CAST(ts AS DATE) AS day, count(*) AS n
          FROM {events} GROUP BY 1, 2
        )
        SELECT 'http_requests_total' AS metric, minute,
               CAST(sum(n) OVER (PARTITION BY day ORDER BY minute ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                    AS BIGINT) AS value
        FROM m
        """,
        ("events",),
    ),
    # application / error log text: one JSON line per request, stack lines after errors
    "log_lines": (
        """
        WITH r AS (
          SELECT event_id, ts, event_type, user_id, value, {ts_ms_text} AS ts_text,
                 CASE WHEN event_type = 'error' THEN 'error' WHEN floor(value * 10) >= 1000 THEN 'warn' ELSE 'info' END
                   AS level,
                 CASE WHEN event_type = 'error' THEN 'error.log' ELSE 'application.log' END AS file
          FROM {events}
        )
        SELECT file, event_id * 2 AS line_no,
               ts_text || ' ' || '{{"timestamp":"' || ts_text || '","level":"' || level
               || '","message":"request ' || event_type || '","requestId":"req-' || CAST(event_id AS STRING)
               || '","ip":"10.0.' || CAST(CAST(floor(CAST(user_id AS DOUBLE) / 256) AS BIGINT) AS STRING) || '.'
               || CAST(user_id % 256 AS STRING) || '","duration":"' || CAST(CAST(floor(value * 10) AS BIGINT) AS STRING) || '"'
               || CASE WHEN floor(value * 10) >= 1000 THEN ',"performanceLog":true' ELSE '' END
               || CASE WHEN event_id % 89 = 0 THEN ',"securityLog":true' ELSE '' END
               || CASE WHEN floor(value * 10) >= 3000 THEN ',"slowQueryLog":true' ELSE '' END
               || CASE WHEN event_type = 'click' THEN ',"businessMetric":true' ELSE '' END
               || CASE WHEN event_id % 4 = 1 THEN ',"cacheMissLog":true' ELSE '' END
               || CASE WHEN event_type = 'error' THEN ',"errorName":"'
                       || CASE WHEN event_id % 2 = 0 THEN 'InternalError' ELSE 'NotFoundError' END || '"' ELSE '' END
               || '}}' AS line
        FROM r
        UNION ALL
        SELECT file, event_id * 2 + 1, '    at handler (worker:' || CAST(event_id % 500 AS STRING) || ')'
        FROM r WHERE event_type = 'error'
        """,
        ("events",),
    ),
}

# Expressions that differ between the two SQL dialects.
DIALECT = {
    "spark": {"ts_ms_text": "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS')", "numbers": "explode(sequence(0L, 3599L))",
              "shift": "timestampadd(MICROSECOND, off_us, ts)"},
    "duckdb": {"ts_ms_text": "strftime(ts, '%Y-%m-%d %H:%M:%S.%g')", "numbers": "unnest(generate_series(0, 3599))",
               "shift": "ts + to_microseconds(off_us)"},
}


def _order() -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in seen or name in RAW_TABLES:
            return
        for dep in DERIVED[name][1]:
            visit(dep)
        seen.append(name)

    for n in DERIVED:
        visit(n)
    return seen


def cte(*names: str) -> str:
    """``WITH`` clause defining the named derived tables (and what they need) for DuckDB."""
    needed: set[str] = set()

    def visit(name: str) -> None:
        if name in RAW_TABLES or name in needed:
            return
        needed.add(name)
        for dep in DERIVED[name][1]:
            visit(dep)

    for n in names:
        visit(n)
    parts = []
    for n in _order():
        if n in needed:
            sql, deps = DERIVED[n]
            parts.append(f"{n} AS ({sql.format(**{d: d for d in deps}, **DIALECT['duckdb'])})")
    return "WITH " + ",\n".join(parts) + "\n"


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FRAMES: dict[tuple, DataFrame] = {}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a lazy DataFrame (same SQL text as the oracle's CTE), built once per session."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, name)
    df = _FRAMES.get(key)
    if df is not None:
        return df
    if name in RAW_TABLES:
        df = raw(spark, sf_dir, name)
    else:
        sql, deps = DERIVED[name]
        frames = {d: derived(spark, sf_dir, d) for d in deps}
        for name_, text in DIALECT["spark"].items():
            sql = sql.replace(f"{{{name_}}}", text)
        df = spark.sql(sql, **frames)
    _FRAMES[key] = df
    return df


@functools.lru_cache(maxsize=None)
def names() -> tuple[str, ...]:
    return tuple(_order())
