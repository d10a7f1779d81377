"""File-based sources: discovery, delimited reads, counts, manifest, multiline logs, profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import register as R
from ..sources import files as FS
from ..sources.fixtures import derived
from .common import AS_OF_DATE
from .registry import query

START_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"


def _catalog(spark, sf):
    root = FS.stage_dataset(spark, sf)
    return FS.catalog(spark, f"{root}/G-NAF")


@query("file_catalog")
def file_catalog(spark, sf):
    """S1 + S2 + S4: data files under the dataset tree and the register table each one feeds."""
    cat = _catalog(spark, sf)
    parts = [FS.table_files(cat, t) for t in FS.TABLE_PATTERNS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # a logical file may be stored as several part files
    return out.groupBy("table_name", "file_name").agg(F.count(F.lit(1)).alias("parts"),
                                                      F.sum("size_bytes").alias("size_bytes"))


def _table_paths(cat, table):
    return [r.path for r in FS.table_files(cat, table).select("path").collect()]  # file list only, not data


def _read_table(spark, cat, table, place=None):
    paths = _table_paths(cat, table)
    return FS.read_delimited(spark, paths, "|", place)


def _lower_cols(df):
    return df.select(*[F.col(c).alias(c.lower()) for c in df.columns])


@query("read_psv")
def read_psv(spark, sf):
    """S3 + S10: discover the four tables' files, read them as text columns and run the register load."""
    cat = _catalog(spark, sf)
    loc = _lower_cols(_read_table(spark, cat, "localities").drop("source_file"))
    st = _lower_cols(_read_table(spark, cat, "streets").drop("source_file"))
    # discovery for geocodes is permissive; the load takes each state's default geocodes alone
    default = cat.filter(F.col("file_name").rlike("^[A-Z]+_ADDRESS_DEFAULT_GEOCODE"))
    geo = _lower_cols(_read_table(spark, default, "geocodes", "place").drop("source_file"))
    ad = _lower_cols(_read_table(spark, cat, "addresses").drop("source_file"))
    ad = ad.withColumn("date_created", F.col("date_created").try_cast("date"))
    return R.load_addresses(ad, R.load_geocodes(geo, "place"), R.load_localities(loc), R.load_streets(st),
                            as_of_date=AS_OF_DATE)


@query("file_record_counts")
def file_record_counts(spark, sf):
    """Data rows per file (header excluded), grouped on the file path metadata column."""
    cat = _catalog(spark, sf)
    out = None
    for t in FS.TABLE_PATTERNS:
        r = _read_table(spark, cat, t).withColumn(
            "file_name", F.regexp_extract("source_file", r"file_name=([^/]+)/[^/]*$", 1))
        c = r.groupBy("file_name").agg(F.count(F.lit(1)).alias("records"))
        c = c.withColumn("table_name", F.lit(t))
        out = c if out is None else out.unionByName(c)
    return out


@query("dataset_manifest")
def dataset_manifest(spark, sf):
    """Size, SHA-256 and modification time per file; the largest file flagged (one task hashes one file)."""
    root = FS.stage_dataset(spark, sf)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.csv").load(f"{root}/G-NAF"))
    m = files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"),
                     F.sha2("content", 256).alias("sha256"))
    largest = m.agg(F.max_by("path", F.struct("size_bytes", "path")).alias("largest_path"))
    return m.crossJoin(largest).select("path", "size_bytes", "modified", "sha256",
                                       (F.col("path") == F.col("largest_path")).alias("is_largest"))


# ------------------------------------------------------------------ multiline logs
LOG_PART = 100_000  # line numbers


def log_parts(lines):
    """Numbered lines with the ``part`` of their log: one for each LOG_PART line numbers, moved to begin with an event.

    Lines before a log's first event have none. Only a row per part is looked up.
    """
    d = lines.withColumn("_chunk", F.floor(F.col("line_no") / LOG_PART))
    first = F.min(F.when(F.col("line").rlike(START_PATTERN), F.col("line_no"))).alias("_first")
    chunks = d.groupBy("file", "_chunk").agg(first)
    earlier = Window.partitionBy("file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_before", F.last(F.when(F.col("_first").isNotNull(), F.col("_chunk")), ignorenulls=True).over(earlier))
    part = F.when(F.col("line_no") >= F.col("_first"), F.col("_chunk")).otherwise(F.col("_before"))
    return d.join(chunks, ["file", "_chunk"], "left").select(*lines.columns, part.alias("part"))


def stage_logs(spark, sf, root: str | None = None) -> str:
    """The log files in a folder of their own, or staged once for all readers."""
    shared = root is None
    root = root or FS.staging_root(spark, sf) + "/logs"
    if shared and FS._fs_exists(spark, f"{root}/_SUCCESS"):
        return root
    # a log is a series of files in path order; no event is cut, so a task holds some parts of a log, not the whole of it
    ordered = log_parts(derived(spark, sf, "log_lines")).repartitionByRange("file", "part").sortWithinPartitions("file", "part", "line_no")
    ordered.select("file", "line").write.mode("overwrite").partitionBy("file").text(root)
    return root


def stitch(lines_df, start_pattern: str = START_PATTERN, log: str | None = None):
    """Glue continuation lines to the previous line that starts with a date.

    Lines are ordered by (log, file, split start, position in split); ``log`` names the column that says which log a file
    belongs to (by default each file is a log). Events are numbered inside each split by a running count of start lines;
    lines before a split's first start line belong to the last event of the nearest earlier split that has one (a lookup
    on the small per-split table). Each event is then one group of its own lines.
    """
    path = F.col("_metadata.file_path")
    d = lines_df.select(
        (F.col(log) if log else path).alias("file"), path.alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").alias("line"))
    d = d.withColumn("is_start", F.col("line").rlike(start_pattern).cast("int"))
    w = Window.partitionBy("path", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("ev", F.sum("is_start").over(w))
    splits = d.groupBy("file", "path", "block").agg(F.max("ev").alias("n_ev"))
    ws = Window.partitionBy("file").orderBy("path", "block")
    splits = splits.withColumn("split", F.row_number().over(ws))
    owner = F.last(F.when(F.col("n_ev") > 0, F.struct("split", "n_ev")), ignorenulls=True)
    splits = splits.withColumn("prev_owner", owner.over(ws.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.join(splits.select("path", "block", "split", "prev_owner"), ["path", "block"])
    own_split = F.when(F.col("ev") > 0, F.col("split")).otherwise(F.col("prev_owner.split"))
    own_ev = F.when(F.col("ev") > 0, F.col("ev")).otherwise(F.col("prev_owner.n_ev"))
    d = d.withColumn("e_split", own_split).withColumn("e_ev", own_ev)
    g = d.groupBy("file", "e_split", "e_ev").agg(
        F.array_sort(F.collect_list(F.struct("split", "pos", "line"))).alias("ls"))
    return g.select(
        "file", F.element_at("ls", 1)["line"].alias("first_line"), F.size("ls").alias("n_lines"),
        F.array_join(F.transform("ls", lambda x: x["line"]), "\n").alias("event_text"))


@query("stitch_multiline")
def stitch_multiline(spark, sf):
    """Multi-line log events (stack lines glued to their event) from the staged log files."""
    root = stage_logs(spark, sf)
    ev = stitch(spark.read.text(root), log="file")
    return ev.select(F.col("file").alias("log_file"),
                     F.substring("first_line", 1, 23).alias("event_ts"), "n_lines", "event_text")


@query("table_profile")
def table_profile(spark, sf):
    """Table statistics (re-aimed set-returning function): rows, files and bytes per raw table and register table."""
    cat = _catalog(spark, sf)
    per_file = None
    for t in FS.TABLE_PATTERNS:
        f = FS.table_files(cat, t).groupBy("table_name").agg(
            F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
        per_file = f if per_file is None else per_file.unionByName(f)
    from . import common as C

    rows = (C.localities(spark, sf).agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit("localities"))
            .unionByName(C.streets(spark, sf).agg(F.count(F.lit(1)).alias("row_count"))
                         .withColumn("table_name", F.lit("streets")))
            .unionByName(C.addresses(spark, sf).agg(F.count(F.lit(1)).alias("row_count"))
                         .withColumn("table_name", F.lit("addresses")))
            .unionByName(C.geocodes(spark, sf).agg(F.count(F.lit(1)).alias("row_count"))
                         .withColumn("table_name", F.lit("geocodes"))))
    return per_file.join(rows, "table_name", "full_outer").select("table_name", "files", "bytes", "row_count")
