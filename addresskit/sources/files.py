"""Raw dataset files: staging, discovery (S1, S2, S4), delimited reading (S3), counts (S5), manifest.

The dataset arrives as ``<STATE>_<TABLE>_psv.psv`` files under a ``G-NAF``
tree. ``stage_dataset`` writes the fixture tables in that shape (one
partition directory per logical file name, ``|``-separated, header row) into
the shared folder the cluster names in ``spark.checkpoint.dir``, so the
discovery and reading code runs against real files. Discovery is a
``binaryFile`` listing with the content column pruned: only paths, sizes and
times are read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .fixtures import derived

# Names that disqualify a file unless the search is for geocodes.
STANDARD_EXCLUSIONS = ["alias", "neighbour", "point", "authority_code", "geocode", "mesh_block", "site", "feature",
                       "aut_psv"]

# (file-name pattern, second pattern or None, extra excludes) per register table
TABLE_PATTERNS = {
    "localities": ("LOCALITY", None, ["STREET_LOCALITY", "LOCALITY_ALIAS", "LOCALITY_POINT", "LOCALITY_NEIGHBOUR"]),
    "streets": ("STREET_LOCALITY", "street", []),
    "addresses": ("ADDRESS_DETAIL", "address", []),
    "geocodes": ("ADDRESS_DEFAULT_GEOCODE", "geocode", []),
}

STATES = ["NSW", "VIC", "QLD", "SA", "WA", "TAS", "NT", "ACT"]


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def staging_root(spark: SparkSession, sf_dir: str) -> str:
    tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:12]
    return f"{checkpoint_dir(spark).rstrip('/')}/staged-{tag}"


def _state_of(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), (F.pmod(key, F.lit(len(STATES))) + 1).cast("int"))


def _write(df: DataFrame, path: str) -> None:
    text = df.select(*[F.col(c).cast("string").alias(c.upper()) if c != "file_name" else F.col(c)
                       for c in df.columns])
    text.write.mode("overwrite").partitionBy("file_name").option("sep", "|").option("header", True).csv(path)


def stage_dataset(spark: SparkSession, sf_dir: str) -> str:
    """Write the raw register files once per input folder; return the dataset root."""
    root = staging_root(spark, sf_dir)
    if _fs_exists(spark, f"{root}/G-NAF/_DONE"):
        return root
    base = f"{root}/G-NAF/G-NAF DEMO/Standard"
    loc = derived(spark, sf_dir, "loc_raw")
    loc = loc.withColumn("file_name", F.concat(_state_of(F.substring("locality_pid", 2, 32).cast("long")),
                                               F.lit("_LOCALITY_psv.psv")))
    _write(loc, f"{base}/locality")
    alias = derived(spark, sf_dir, "loc_raw").filter(F.substring("locality_pid", 2, 32).cast("long") % 50 == 0)
    alias = alias.select("locality_pid", "locality_name").withColumn("file_name", F.lit("VIC_LOCALITY_ALIAS_psv.psv"))
    _write(alias, f"{base}/locality_alias")
    st = derived(spark, sf_dir, "streets_raw")
    st = st.withColumn("file_name", F.concat(_state_of(F.substring("street_locality_pid", 2, 32).cast("long")),
                                             F.lit("_STREET_LOCALITY_psv.psv")))
    _write(st, f"{base}/street_locality")
    ad = derived(spark, sf_dir, "address_detail")
    key = F.substring("address_detail_pid", 3, 32).cast("long")
    _write(ad.withColumn("file_name", F.concat(_state_of(key), F.lit("_ADDRESS_DETAIL_psv.psv"))), f"{base}/address_detail")
    geo = derived(spark, sf_dir, "geocodes_raw")
    gkey = F.substring("address_detail_pid", 3, 32).cast("long")
    geo = geo.withColumn("file_name", F.concat(_state_of(gkey), F.lit("_ADDRESS_DEFAULT_GEOCODE_psv.psv")))
    # rows of one address lie in one file, in delivery order
    geo = geo.repartition("file_name", F.pmod(gkey, F.lit(8))).sortWithinPartitions("file_name", "load_seq")
    _write(geo.drop("load_seq"), f"{base}/address_default_geocode")
    site = geo.filter(gkey % 97 == 1).select("address_detail_pid", "latitude", "longitude").withColumn(
        "file_name", F.lit("VIC_ADDRESS_SITE_GEOCODE_psv.psv"))
    _write(site, f"{base}/address_site_geocode")
    auth = spark.range(1).select(F.lit("ST").alias("code"), F.lit("STREET").alias("name"),
                                 F.lit("Authority_Code_STREET_TYPE_AUT_psv.psv").alias("file_name"))
    _write(auth, f"{root}/G-NAF/G-NAF DEMO/Authority Code")
    spark.range(1).select(F.lit("done").alias("v")).coalesce(1).write.mode("overwrite").text(f"{root}/G-NAF/_DONE")
    return root


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """Every data file under ``root`` with its logical name, size and time (content not read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.csv").load(root).select("path", "length", "modificationTime"))
    logical = F.regexp_extract("path", r"file_name=([^/]+)/[^/]*$", 1)
    base = F.regexp_extract("path", r"([^/]+)$", 1)
    name = F.when(logical != "", F.regexp_replace(logical, "%20", " ")).otherwise(base)
    return files.select("path", name.alias("file_name"), F.col("length").alias("size_bytes"),
                        F.col("modificationTime").alias("modified"))


def match_files(cat: DataFrame, pattern: str, pattern2: str | None = None, excludes=()) -> DataFrame:
    """S1 / S2 selection rules on the lower-cased logical file name."""
    n = F.lower("file_name")
    hit = n.contains(pattern.lower())
    if pattern2:
        hit = hit | n.contains(pattern2.lower())
    ext = n.endswith(".csv") | n.endswith(".psv")
    keep = hit & ext
    geocode_search = "geocode" in pattern.lower() or (pattern2 is not None and "geocode" in pattern2.lower())
    if not geocode_search:
        for e in list(excludes) + STANDARD_EXCLUSIONS:
            keep = keep & ~n.contains(e.lower())
    return cat.filter(keep)


def table_files(cat: DataFrame, table: str) -> DataFrame:
    p1, p2, ex = TABLE_PATTERNS[table]
    return match_files(cat, p1, p2, ex).withColumn("table_name", F.lit(table))


def read_delimited(spark: SparkSession, paths: list[str], sep: str = "|", place: str | None = None) -> DataFrame:
    """S3: header row, trimmed values, empty lines skipped, every column text (no inference).

    A file whose header differs from the first one's fails the read: its values would land in wrong columns.
    ``place`` names a column for each row's place in the delivery (file, block, row).
    """
    rows = (spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True)
            .option("ignoreTrailingWhiteSpace", True).option("inferSchema", False).option("enforceSchema", False).csv(paths)
            .withColumn("source_file", F.col("_metadata.file_path")))
    if place is None:
        return rows
    return rows.withColumn(place, F.struct("source_file", F.col("_metadata.file_block_start").alias("block"),
                                           F.monotonically_increasing_id().alias("row")))
