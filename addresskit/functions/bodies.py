"""the rules of JSON request bodies, the first broken one of each kind of request by its code.

A body is parsed once into a variant; a rule asks for the JSON type of a value, so that a number in quotes, a null and a value that
is not there are told apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geo as G

# Limits of the request contract.
MAX_RADIUS, MAX_LIMIT, MAX_BATCH = 5000, 50, 100
REVERSE_RADIUS, REVERSE_LIMIT = 1000, 10
MAX_ADDRESS, MIN_ADDRESS = 500, 3
OPERATIONS = ["proximity", "boundary", "statistical"]
SYSTEMS = ["WGS84", "GDA2020"]
# Fixed value: the code of a body that cannot be read.
UNREADABLE = "VALIDATION_ERROR"


def parts(body: Column, path: str) -> Column:
    """JSON type, text, number and truth of the value at a place; all null if there is none."""
    kind = F.schema_of_variant(F.variant_get(body, path, "variant"))
    return F.struct(F.when(F.variant_get(body, path, "variant").isNotNull(), kind).alias("type"), F.try_variant_get(body, path, "string").alias("text"),
                    F.try_variant_get(body, path, "double").alias("number"), F.try_variant_get(body, path, "boolean").alias("truth"))


class Value:
    """A place in a body by its ``parts``: is it there, of what type, is it what a condition takes for true."""

    def __init__(self, p: Column):
        self.type = p["type"]
        self.there = self.type.isNotNull()
        self.is_string, self.is_boolean = self._is("STRING"), self._is("BOOLEAN")
        self.is_array, self.is_object = self._is("ARRAY"), self._is("OBJECT")
        self.text = F.when(self.is_string, p["text"])
        self.number = F.when(self._is("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), p["number"])
        self.finite = F.coalesce(F.abs(self.number) < float("inf"), F.lit(False))
        # null, false, 0 and "" are as good as nothing
        nothing = ~self.there | self._is("VOID") | (self.text == "") | (self.number == 0) | (self.is_boolean & ~p["truth"])
        self.given = ~F.coalesce(nothing, F.lit(False))

    def _is(self, *names: str) -> Column:
        return F.coalesce(F.regexp_like(self.type, F.lit(f"^({'|'.join(names)})")), F.lit(False))

    def whole(self, most: int) -> Column:
        """A whole number from 1 to ``most``."""
        return self.finite & (self.number == F.floor(self.number)) & (self.number >= 1) & (self.number <= most)

    def outside(self, most: int) -> Column:
        return self.finite & ((self.number < 1) | (self.number > most))

    def blank(self) -> Column:
        """No text with anything but white space in it."""
        return ~self.given | ~self.is_string | (F.length(F.trim(self.text)) == 0)


def _optional(v: Value, good: Column) -> Column:
    return v.there & ~good


PATHS = ["coordinates", "coordinates.latitude", "coordinates.longitude", "address", "radius", "limit", "propertyTypes", "includeLGA",
         "includeElectoral", "includePostal", "includeDistance", "includeBearing", "includeHierarchy", "operations", "options",
         "options.batchSize", "options.progressCallback", "options.failFast", "q", "coordinateSystem", "latitude", "longitude"]


def _rules(places: Column, b: Column) -> dict[str, list[tuple[str, Column]]]:
    def at(path: str) -> Value:
        return Value(places[f"p{PATHS.index(path)}"])

    place, address = at("coordinates"), at("address")
    lat, lon = at("coordinates.latitude"), at("coordinates.longitude")
    numbers = lat.finite & lon.finite
    coordinates = [("INVALID_COORDINATES", place.given & ~numbers),
                   ("COORDINATES_OUT_OF_BOUNDS", place.given & ~F.coalesce(G.in_bounds(lat.number, lon.number, "api"), F.lit(False)))]
    located = [("MISSING_LOCATION", ~place.given & ~address.given), *coordinates,
               ("INVALID_ADDRESS", address.given & (~address.is_string | (F.length(F.trim(address.text)) < MIN_ADDRESS)))]
    radius, limit, types = at("radius"), at("limit"), at("propertyTypes")
    all_text = types.is_array & F.coalesce(F.regexp_like(types.type, F.lit("^ARRAY<(STRING|VOID)>$")), F.lit(False))
    flags = [at(f) for f in ("includeLGA", "includeElectoral", "includePostal")]
    distance, bearing, hierarchy = at("includeDistance"), at("includeBearing"), at("includeHierarchy")

    operations, options = at("operations"), at("options")
    listed = F.when(operations.is_array, F.try_variant_get(b, "$.operations", "array<variant>"))
    size, progress, fail = at("options.batchSize"), at("options.progressCallback"), at("options.failFast")

    def broken(o: Column) -> Column:
        name, kind, parameters = (Value(parts(o, f"$.{c}")) for c in ("id", "type", "parameters"))
        return (F.when(~name.given | ~name.is_string, F.lit("INVALID_OPERATION_ID"))
                .when(~F.coalesce(kind.text.isin(*OPERATIONS), F.lit(False)), F.lit("INVALID_OPERATION_TYPE"))
                .when(~(parameters.is_object | parameters.is_array), F.lit("MISSING_PARAMETERS")))

    first = F.get(F.filter(F.transform(listed, broken), lambda c: c.isNotNull()), F.lit(0))
    q, system = at("q"), at("coordinateSystem")
    known = F.coalesce(system.text.isin(*SYSTEMS), F.lit(False))
    flat, flon = at("latitude"), at("longitude")
    text = [("MISSING_ADDRESS", address.blank()), ("ADDRESS_TOO_LONG", F.length(address.text) > MAX_ADDRESS)]
    return {
        "proximity": [*located, ("INVALID_RADIUS", _optional(radius, radius.whole(MAX_RADIUS))),
                      ("INVALID_LIMIT", _optional(limit, limit.whole(MAX_LIMIT))), ("INVALID_PROPERTY_TYPES", _optional(types, all_text)),
                      ("INVALID_INCLUDE_DISTANCE", _optional(distance, distance.is_boolean)),
                      ("INVALID_INCLUDE_BEARING", _optional(bearing, bearing.is_boolean))],
        "boundary": [("MISSING_COORDINATES", ~place.given), *coordinates,
                     *[("INVALID_BOOLEAN_FLAG", _optional(f, f.is_boolean)) for f in flags]],
        "statistical": [*located, ("INVALID_INCLUDE_HIERARCHY", _optional(hierarchy, hierarchy.is_boolean))],
        "batch": [("MISSING_OPERATIONS", ~operations.is_array | (F.size(listed) == 0)), ("BATCH_TOO_LARGE", F.size(listed) > MAX_BATCH),
                  *[(c, first == c) for c in ("INVALID_OPERATION_ID", "INVALID_OPERATION_TYPE", "MISSING_PARAMETERS")],
                  ("INVALID_BATCH_SIZE", options.given & size.given & ~size.whole(MAX_BATCH)),
                  ("INVALID_PROGRESS_CALLBACK", options.given & _optional(progress, progress.is_boolean)),
                  ("INVALID_FAIL_FAST", options.given & _optional(fail, fail.is_boolean))],
        "search": [("MISSING_QUERY", q.blank()), ("INVALID_LIMIT", limit.given & limit.outside(MAX_LIMIT))],
        "validate": text,
        "geocode": [*text, ("INVALID_COORDINATE_SYSTEM", system.given & ~known)],
        "reverse": [("INVALID_COORDINATES", ~flat.finite | ~flon.finite), ("INVALID_LATITUDE", F.abs(flat.number) > 90),
                    ("INVALID_LONGITUDE", F.abs(flon.number) > 180), ("INVALID_COORDINATE_SYSTEM", system.given & ~known),
                    ("INVALID_RADIUS", radius.given & radius.outside(REVERSE_RADIUS)),
                    ("INVALID_LIMIT", limit.given & limit.outside(REVERSE_LIMIT))],
    }


def with_error_code(requests: DataFrame, kind: str, body: str) -> DataFrame:
    """``requests`` with ``error_code``: the first broken rule of each, null if all are kept; ``body`` is JSON text.

    Every place that a rule asks for is read from the body once, before the rules.
    """
    b = requests.withColumn("_body", F.try_parse_json(body))
    b = b.withColumn("_places", F.struct(*[parts(F.col("_body"), f"$.{p}").alias(f"p{i}") for i, p in enumerate(PATHS)]))
    code = F.lit(None).cast("string")
    for name, rules in _rules(F.col("_places"), F.col("_body")).items():
        broken = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules], F.lit(None).cast("string"))
        code = F.when(F.col(kind) == name, broken).otherwise(code)
    return b.withColumn("error_code", F.when(F.col("_body").isNull(), F.lit(UNREADABLE)).otherwise(code)).drop("_body", "_places")
