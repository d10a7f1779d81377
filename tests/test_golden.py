"""Exact-value examples taken from the reference's own unit tests and code paths."""

from pyspark.sql import functions as F

from addresskit.functions import address as A
from addresskit.functions import codes as K
from addresskit.functions import geo as G
from addresskit.functions import logs as L
from addresskit.operators import text as T


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_lga_category(spark):
    cases = {"City of Melbourne": "City", "Shire of Yarra Ranges": "Shire", "Town of Cambridge": "Town",
             "Borough of Queenscliffe": "Borough", "District Council of Grant": "District",
             "Regional Council of Goyder": "Council", "Unincorporated": "Council"}
    for name, cat in cases.items():
        assert one(spark, K.lga_category(F.lit(name))) == cat


def test_delivery_office(spark):
    cases = {"2000": "NSW", "3000": "VIC", "4000": "QLD", "5000": "SA", "6000": "WA", "7000": "TAS",
             "0800": "NT", "0200": "ACT", "2600": "NSW", "8000": "Unknown", "abc": "Unknown"}
    for pc, office in cases.items():
        assert one(spark, K.delivery_office(F.lit(pc))) == office


def test_statistical_area_codes(spark):
    sa2 = F.lit("206639700")
    assert one(spark, K.sa3_from_sa2(sa2)) == "20663"
    assert one(spark, K.sa4_from_sa2(sa2)) == "206"
    assert one(spark, K.ccd_from_mesh_block(F.lit("20663970000"))) == "20663970"
    assert one(spark, K.sa_name(F.lit("20663"), "SA3")) == "VIC SA3 20663"
    assert one(spark, K.sa_name(F.lit("206"), "SA4")) == "VIC SA4 206"
    assert one(spark, K.sa_name(F.lit("Unknown"), "SA2")) == "Unknown SA2"
    assert one(spark, K.state_from_sa_code(F.lit("9123"))) == "AUS"
    assert one(spark, K.state_from_sa_code(F.lit("1123"))) == "NSW"


def test_state_and_precision_maps(spark):
    assert one(spark, A.state_from_pid(F.lit("2"))) == "VIC"
    assert one(spark, A.state_from_pid(F.lit("42"))) == "NSW"
    assert one(spark, A.precision_from_type(F.lit("Building Centroid"), "parser")) == "PROPERTY"
    assert one(spark, A.precision_from_type(F.lit("Building Centroid"))) == "REGION"
    assert one(spark, A.precision_from_type(F.lit(None).cast("string"))) == "LOCALITY"
    assert one(spark, A.reliability_load(F.lit("0"))) == 2
    assert one(spark, A.reliability_parser(F.lit("4"))) == 2


def test_formatted_address(spark):
    c = F.lit
    fa = A.formatted_address(c("UNIT"), c("5"), c(None).cast("string"), c("12"), c("MAIN"), c("ST"),
                             c("SYDNEY"), c("NSW"), c("2000"))
    assert one(spark, fa) == "UNIT 5, 12, MAIN ST, SYDNEY NSW 2000"
    line = A.address_line(c(None).cast("string"), c("5"), c("TOWER"), c("12"), c("MAIN"), c(None).cast("string"))
    assert one(spark, line) == "TOWER, 12, MAIN"


def test_text_functions(spark):
    assert one(spark, T.normalise_address(F.lit("  12   Main St,,  Sydney. "))) == "12 Main St, Sydney"
    assert one(spark, T.normalise_address(F.lit("12 Main St Sydney."))) == "12 Main St Sydney"
    assert one(spark, F.array_join(T.query_terms(F.lit("123 Main Street, Sydney NSW")), " & ")) == \
        "123 & main & sydney & nsw"
    assert one(spark, F.array_join(T.query_terms(F.lit("Street Road")), " & ")) == "street & road"
    assert one(spark, T.street_number(F.lit("  42 Smith St"))) == "42"
    assert one(spark, T.street_number(F.lit("Smith St"))) is None
    s = one(spark, T.positional_split(F.lit("12 George Street Sydney NSW")))
    assert (s["number"], s["street"], s["locality"]) == ("12", "George", "Sydney NSW")


def test_haversine_and_bearing(spark):
    # Melbourne -> Sydney, about 713 km; bearing north-east
    m = one(spark, G.haversine_m(F.lit(-37.8136), F.lit(144.9631), F.lit(-33.8688), F.lit(151.2093)))
    assert 713000 < m < 715000
    b = one(spark, G.bearing_deg(F.lit(-37.8136), F.lit(144.9631), F.lit(-33.8688), F.lit(151.2093)))
    assert 50 < b < 60


def test_route_and_priority(spark):
    assert one(spark, L.route_pattern(F.lit("/api/v1/addresses/GANSW701G001234"))) == "/api/v1/addresses/:gnaf_pid"
    assert one(spark, L.route_pattern(F.lit("/api/v1/health/foo"))) == "/api/v1/health/*"
    assert one(spark, L.route_pattern(F.lit("/other"))) == "/other"
    assert one(spark, L.endpoint_type(F.lit("/api/v1/admin/status"))) == "admin"
    assert one(spark, L.request_priority(F.lit("/api/v1/addresses/validate"))) == "high"
    assert one(spark, L.request_priority(F.lit("/api/v1/spatial/proximity"))) == "medium"
    assert one(spark, L.request_priority(F.lit("/api/v1/bulk/x"))) == "low"


def test_masking_and_redaction(spark):
    assert one(spark, L.mask_query(F.lit("SELECT * FROM a WHERE id = 12345 AND n = 'bob'"))) == \
        "SELECT * FROM a WHERE id = *** AND n = '***'"
    assert one(spark, L.mask_key(F.lit("user:42:session:ab-12:email:x@y.z"))) == "user:***:session:***:email:***"
    red = one(spark, L.redact_json(F.lit('{"a":1,"password":"x","auth":{"t":2},"n":{"token":"y"}}')))
    assert red == '{"a":1,"password":"***REDACTED***","auth":"***REDACTED***","n":{"token":"***REDACTED***"}}'
    deep = one(spark, L.redact_json(F.lit('{"auth":{"a":{"b":"s3cr3t"},"c":[1,{"d":"}"}]},"l":[{"jwt":[[1]]},2.5,null]}')))
    assert deep == '{"auth":"***REDACTED***","l":[{"jwt":"***REDACTED***"},2.5,null]}'
    assert one(spark, L.redact_json(F.lit('{"password":"x"'))) == L.REDACTED
    assert one(spark, L.redact_json(F.lit(None).cast("string"))) is None
    assert one(spark, L.is_suspicious(F.lit("q=<script>alert(1)</script>")))
    assert not one(spark, L.is_suspicious(F.lit("q=main street")))


def test_request_error_codes(spark):
    from addresskit.plans.requests import request_error_code

    rows = [
        ("proximity", None, None, None, 1000, 10, "MISSING_LOCATION"),
        ("proximity", float("nan"), 144.9, None, 1000, 10, "INVALID_COORDINATES"),
        ("proximity", -60.0, 144.9, None, 1000, 10, "COORDINATES_OUT_OF_BOUNDS"),
        ("proximity", None, None, "xy", 1000, 10, "INVALID_ADDRESS"),
        ("proximity", -37.8, 144.9, None, 0, 10, "INVALID_RADIUS"),
        ("proximity", -37.8, 144.9, None, 1000, 51, "INVALID_LIMIT"),
        ("proximity", -37.8, 144.9, None, 5000, 50, None),
        ("boundary", None, None, "12 Main St", None, None, "MISSING_COORDINATES"),
        ("statistical", None, None, "12 Main St", None, None, None),
        ("isochrone", -37.8, 144.9, None, None, None, "INVALID_OPERATION_TYPE"),
    ]
    df = spark.createDataFrame([r[:6] for r in rows], "op_type string, latitude double, longitude double, "
                               "address string, radius long, max_results long")
    got = [r.e for r in df.select(request_error_code(df).alias("e")).collect()]
    assert got == [r[6] for r in rows]


def test_read_psv_equals_the_register_load(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL

    q = E.queries()
    a, b = q["read_psv"](spark, SF_SMALL), q["etl_addresses"](spark, SF_SMALL)
    assert set(a.columns) == set(b.columns)
    assert a.select(b.columns).exceptAll(b).count() == 0 and a.count() == b.count() > 0
