"""Parser-variant record transform (P2, P5, P6, P7/P8 parser, P9-P13 parser).

Raw 39-column records -> nested address documents. Optional members are
nullable struct fields; every member is a built-in column expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import address as A


def combined_numbers(df: DataFrame) -> DataFrame:
    c = F.col
    return df.select(
        "address_detail_pid",
        A.combined_number(c("lot_number_prefix"), c("lot_number"), c("lot_number_suffix")).alias("lot_number"),
        A.combined_number(c("flat_number_prefix"), c("flat_number"), c("flat_number_suffix")).alias("flat_number"),
        A.combined_number(c("number_first_prefix"), c("number_first"), c("number_first_suffix")).alias("street_number"),
    )


def formatted_full(df: DataFrame) -> DataFrame:
    """P5: parser-variant formatted address (combined numbers, street suffix, record postcode)."""
    c = F.col
    flat = A.combined_number(c("flat_number_prefix"), c("flat_number"), c("flat_number_suffix"))
    number = A.combined_number(c("number_first_prefix"), c("number_first"), c("number_first_suffix"))
    text = F.concat_ws(
        ", ",
        F.when(c("flat_type").isNotNull() & c("flat_number").isNotNull(), F.concat_ws(" ", c("flat_type"), flat)),
        c("building_name"),
        number,
        A.street_part(c("street_name"), c("street_type_code"), c("street_suffix_code")),
        F.concat_ws(" ", c("locality_name"), c("state_abbreviation"), c("postcode")),
    )
    return df.select("address_detail_pid", text.alias("formatted_address"))


def parsed_columns(df: DataFrame) -> DataFrame:
    """Flat parser outputs: scores, precision, state, class, reliability, status."""
    c = F.col
    return df.select(
        "address_detail_pid",
        A.confidence_parser(c("street_name"), c("number_first"), c("postcode"), c("street_type_code"))
        .alias("confidence"),
        A.completeness(c("street_name"), c("number_first"), c("postcode"), c("street_type_code"), c("building_name"),
                       c("flat_number"), c("lot_number"), c("legal_parcel_id"), c("geocode_type"), c("reliability"))
        .alias("completeness"),
        A.precision_from_type(c("geocode_type"), "parser").alias("precision"),
        A.state_from_abbreviation(c("state_abbreviation")).alias("state_code"),
        A.locality_class_from_name(c("locality_name")).alias("locality_class"),
        A.reliability_parser(c("reliability")).alias("reliability"),
        A.status_from_text(c("address_status")).alias("status"),
    )


def address_struct(df: DataFrame) -> DataFrame:
    """Nested address document per record (required fields checked first: F1 parser)."""
    c = F.col
    ok = (
        c("address_detail_pid").isNotNull() & c("locality_name").isNotNull() & c("state_abbreviation").isNotNull()
        & c("latitude").isNotNull() & c("longitude").isNotNull()
    )
    p = parsed_columns(df).alias("p")
    f = formatted_full(df).alias("f")
    base = df.filter(ok).join(p, "address_detail_pid").join(f, "address_detail_pid")
    number = A.combined_number(c("number_first_prefix"), c("number_first"), c("number_first_suffix"))
    doc = F.struct(
        c("address_detail_pid").alias("gnafPid"),
        c("f.formatted_address").alias("address"),
        F.struct(
            c("building_name").alias("buildingName"),
            A.combined_number(c("lot_number_prefix"), c("lot_number"), c("lot_number_suffix")).alias("lotNumber"),
            F.struct(c("flat_type").alias("type"),
                     A.combined_number(c("flat_number_prefix"), c("flat_number"), c("flat_number_suffix"))
                     .alias("number")).alias("flatNumber"),
            number.alias("streetNumber"),
            F.struct(c("street_name").alias("name"), F.coalesce(c("street_type_code"), F.lit("ST")).alias("type"),
                     c("street_suffix_code").alias("suffix")).alias("street"),
            F.struct(c("locality_name").alias("name"), c("p.locality_class").alias("class")).alias("locality"),
            c("p.state_code").alias("state"),
            F.coalesce(c("postcode"), F.lit("")).alias("postcode"),
        ).alias("components"),
        F.struct(c("latitude"), c("longitude"), c("p.precision").alias("precision"),
                 c("p.reliability").alias("reliability"), F.lit("GDA2020").alias("crs")).alias("coordinates"),
        F.struct(c("p.confidence").alias("confidence"), c("p.completeness").alias("completeness"),
                 F.lit("PENDING").alias("status")).alias("quality"),
        F.struct(c("legal_parcel_id").alias("legalParcelId"), c("p.status").alias("status")).alias("metadata"),
    )
    return base.select(doc.alias("address"))
