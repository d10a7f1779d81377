"""Register load (S6-S10, F1-F3, J1, J2, P1-P14) as DataFrame transforms.

Every function is ``DataFrame(s) -> DataFrame``; reading and writing live in
``sources``. At full scale the address / geocode join is a sort-merge join on
``address_detail_pid`` (both sides are the size of the register); localities
and streets are small dimension tables that AQE broadcasts once their measured
size is under the broadcast threshold, and sort-merge joins otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address as A
from ..functions import geo as G

DEFAULT_BATCH_ID = "batch"


def dim_states(spark: SparkSession) -> DataFrame:
    """State reference table, including OT (D3)."""
    return spark.createDataFrame(A.STATE_NAMES, "state_code string, state_name string")


def _blank(df: DataFrame, cols) -> DataFrame:
    return df.select(
        *[A.blank_to_null(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns]
    )


def _number(df: DataFrame, name: str):
    """Strict numeric parse of a raw text column (D16: trailing junk -> null)."""
    if dict(df.dtypes)[name] == "string":
        return A.blank_to_null(F.col(name)).try_cast("double")
    return F.col(name).cast("double")


def locality_reason(pid, name, state_pid):
    """first failing check, or null when valid."""
    return (
        F.when(pid.isNull(), F.lit("Missing LOCALITY_PID"))
        .when(name.isNull(), F.lit("Missing LOCALITY_NAME"))
        .when(state_pid.isNull(), F.lit("Missing STATE_PID"))
        .when(~state_pid.isin(*A.STATE_BY_PID), F.concat(F.lit("Unknown STATE_PID: "), state_pid))
    )


def checked_localities(loc_raw: DataFrame) -> DataFrame:
    """Raw locality rows with ``reject_reason`` (null = valid)."""
    s = _blank(loc_raw, {"locality_pid", "locality_name", "locality_class_code", "state_pid", "primary_postcode"})
    return s.withColumn(
        "reject_reason", locality_reason(F.col("locality_pid"), F.col("locality_name"), F.col("state_pid"))
    )


def load_localities(loc_raw: DataFrame) -> DataFrame:
    """Valid localities mapped to register columns."""
    c = checked_localities(loc_raw).filter(F.col("reject_reason").isNull())
    return c.select(
        "locality_pid",
        "locality_name",
        F.coalesce("locality_class_code", F.lit("S")).alias("locality_class"),
        A.state_from_pid(F.col("state_pid")).alias("state_code"),
        F.col("primary_postcode").alias("postcode"),
        F.lit(None).cast("double").alias("latitude"),
        F.lit(None).cast("double").alias("longitude"),
    )


def locality_rejects(loc_raw: DataFrame) -> DataFrame:
    """F2 reject path."""
    c = checked_localities(loc_raw).filter(F.col("reject_reason").isNotNull())
    return c.select("locality_pid", "locality_name", "state_pid", "reject_reason")


def load_streets(streets_raw: DataFrame) -> DataFrame:
    """S8 + F3: pid, name and locality present; empty type/suffix -> null."""
    s = _blank(streets_raw, set(streets_raw.columns))
    s = s.filter(
        F.col("street_locality_pid").isNotNull() & F.col("street_name").isNotNull() & F.col("locality_pid").isNotNull()
    )
    return s.select(
        "street_locality_pid",
        "street_name",
        F.col("street_type_code").alias("street_type"),
        F.col("street_suffix_code").alias("street_suffix"),
        "locality_pid",
    )


def load_geocodes(geo_raw: DataFrame, order_col: str) -> DataFrame:
    """Keep rows with pid, latitude and longitude; the later row wins per pid.

    ``order_col`` holds the delivery order of the rows (a sequence number, or the place in the files that
    ``read_delimited`` gives). The aggregate has a map-side partial, so duplicates collapse before the shuffle.
    """
    g = geo_raw.select(
        A.blank_to_null(F.col("address_detail_pid")).alias("address_detail_pid"),
        _number(geo_raw, "latitude").alias("latitude"),
        _number(geo_raw, "longitude").alias("longitude"),
        F.coalesce(A.blank_to_null(F.col("geocode_type_code")), F.lit("UNKNOWN")).alias("geocode_type"),
        F.col(order_col).alias("_order"),
    )
    g = g.filter(F.col("address_detail_pid").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    latest = g.groupBy("address_detail_pid").agg(
        F.max_by(F.struct("latitude", "longitude", "geocode_type"), F.col("_order")).alias("g")
    )
    return latest.select("address_detail_pid", "g.latitude", "g.longitude", "g.geocode_type")


ADDRESS_COLUMNS = [
    "address_detail_pid", "gnaf_pid", "building_name", "lot_number", "flat_type", "flat_number",
    "number_first", "number_last", "street_locality_pid", "locality_pid", "street_name", "street_type",
    "locality_name", "state_code", "postcode", "address_line", "formatted_address", "latitude", "longitude",
    "coordinate_precision", "coordinate_reliability", "coordinate_crs", "confidence_score",
    "completeness_score", "validation_status", "lga_code", "lga_name", "legal_parcel_id", "address_status",
    "gnaf_date_created", "statistical_area_2", "mesh_block_code", "import_batch_id",
]


def load_addresses(
    detail_raw: DataFrame,
    geocodes: DataFrame,
    localities: DataFrame,
    streets: DataFrame | None = None,
    as_of_date: str = "2024-01-01",
    batch_id: str | None = None,
    bounds: str = "load",
) -> DataFrame:
    """Address detail -> register rows.

    F1 required ids, J1 inner join to the default geocode, F4 bounds (``load``
    box), J2 inner join to valid localities, street name/type from the record
    or (D5) from the street table, then P1/P3/P4/P7/P8/P9/P12.
    """
    a = located_details(detail_raw, geocodes, bounds)
    loc = localities.select(
        "locality_pid", "locality_name", "state_code", F.col("postcode").alias("locality_postcode")
    )
    a = a.join(loc, "locality_pid", "inner")  # J2
    if "street_name" not in a.columns:  # D5: street from the street table
        if streets is None:
            raise ValueError("address records carry no street name; pass the street table")
        st = streets.select("street_locality_pid", "street_name", F.col("street_type").alias("street_type_code"))
        a = a.join(st, "street_locality_pid", "left")
    return register_rows(a, as_of_date, batch_id)


def located_details(detail_raw: DataFrame, geocodes: DataFrame, bounds: str = "load") -> DataFrame:
    """Detail rows that have their ids and a default geocode in bounds."""
    text_cols = {c for c, t in detail_raw.dtypes if t == "string"}
    d = _blank(detail_raw, text_cols)
    d = d.filter(F.col("address_detail_pid").isNotNull() & F.col("locality_pid").isNotNull())  # F1
    a = d.join(geocodes, "address_detail_pid", "inner")  # J1
    return a.filter(G.in_bounds(F.col("latitude"), F.col("longitude"), bounds))  # F4


def register_rows(a: DataFrame, as_of_date: str = "2024-01-01", batch_id: str | None = None, *more: str) -> DataFrame:
    """Register columns of detail rows joined to geocode, locality and street, and the columns ``more``."""
    for opt in ("geocode_type_rec", "gnaf_pid", "lot_number", "number_last", "legal_parcel_id",
                "lga_code", "lga_name", "address_status", "statistical_area_2", "mesh_block_code", "import_batch_id"):
        if opt not in a.columns:
            a = a.withColumn(opt, F.lit(None).cast("string"))

    c = F.col
    out = a.select(
        c("address_detail_pid"),
        F.coalesce(c("gnaf_pid"), c("address_detail_pid")).alias("gnaf_pid"),
        c("building_name"),
        c("lot_number"),
        c("flat_type_code").alias("flat_type"),
        c("flat_number"),
        c("number_first"),
        c("number_last"),
        c("street_locality_pid"),
        c("locality_pid"),
        c("street_name"),
        c("street_type_code").alias("street_type"),
        c("locality_name"),
        c("state_code"),
        c("postcode"),
        A.address_line(c("flat_type_code"), c("flat_number"), c("building_name"), c("number_first"),
                       c("street_name"), c("street_type_code")).alias("address_line"),
        A.formatted_address(c("flat_type_code"), c("flat_number"), c("building_name"), c("number_first"),
                            c("street_name"), c("street_type_code"), c("locality_name"), c("state_code"),
                            F.coalesce(c("postcode"), c("locality_postcode"))).alias("formatted_address"),
        c("latitude"),
        c("longitude"),
        A.precision_from_type(c("geocode_type")).alias("coordinate_precision"),
        A.reliability_load(c("reliability")).alias("coordinate_reliability"),
        F.lit("GDA2020").alias("coordinate_crs"),
        A.confidence_load(c("street_name"), c("number_first"), c("postcode")).alias("confidence_score"),
        A.completeness(c("street_name"), c("number_first"), c("postcode"), c("street_type_code"),
                       c("building_name"), c("flat_number"), c("lot_number"), c("legal_parcel_id"),
                       c("geocode_type_rec"), c("reliability")).alias("completeness_score"),
        F.lit("PENDING").alias("validation_status"),
        c("lga_code"),
        c("lga_name"),
        c("legal_parcel_id"),
        F.when(c("address_status").isNull(), F.lit("CURRENT"))
        .otherwise(A.status_from_text(c("address_status"))).alias("address_status"),
        F.coalesce(c("date_created").cast("date"), F.to_date(F.lit(as_of_date))).alias("gnaf_date_created"),
        c("statistical_area_2"),
        c("mesh_block_code"),
        (F.lit(batch_id) if batch_id else F.coalesce(c("import_batch_id"), F.lit(DEFAULT_BATCH_ID)))
        .alias("import_batch_id"),
        *more,
    )
    return out


def address_points(addresses: DataFrame, cell_m: float = 1000.0) -> DataFrame:
    """Derived planar geometry (EPSG:3857) and grid cell of each address."""
    x = G.mercator_x(F.col("longitude"))
    y = G.mercator_y(F.col("latitude"))
    return (
        addresses.withColumn("x", x)
        .withColumn("y", y)
        .withColumn("cell_x", G.grid_cell(F.col("x"), cell_m))
        .withColumn("cell_y", G.grid_cell(F.col("y"), cell_m))
    )
